"""Finding evaluation passages in a training corpus, with suffix arrays of corpus shards."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinweave.runtime import Shelf, ship

#: Letters of corpus text that one suffix array holds; a longer text is a shard of its own.
SHARD_LETTERS = 2_000_000
#: Letters of a verbatim match that make it a seed; where every letter is a word (Chinese, Japanese, Thai), fewer.
SEED, SEED_DENSE = 20, 5
#: Letters that a chain of seeds must hold, less its prices, before running words are looked at.
CHAIN, CHAIN_DENSE = 55, 12
#: Evaluation items of one block; a task searches its shard for one block after the other.
ITEM_BLOCK = 5_000
#: Blocks that a task keeps prepared between shards.
KEPT_BLOCKS = 8
#: Pairs of a test suffix and a place that are looked at together.
_PAIRS = 4_000_000

_POINTS = 0x110000
_SPLIT, _MARK = 0, 1  # what is no letter, and what belongs to the letter before it
#: Scripts written without spaces: every letter counts as a word. Fixed values (Unicode blocks).
_DENSE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))

#: White space, which parts words. Fixed values (Unicode).
_BLANK = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)

_folded = np.zeros(_POINTS, np.uint32)
_known = np.zeros(_POINTS, bool)
_dense = np.zeros(_POINTS, bool)
for _lo, _hi in _DENSE:
    _dense[_lo : _hi + 1] = True


def fold_letter(c: str) -> int:
    """The code point that stands for a letter or digit of any script, without accents and case; else 0, or 1 for an accent by itself."""
    kind = unicodedata.category(c)
    if kind[0] == "M":
        return _MARK if unicodedata.combining(c) not in (0, 9) else ord(c)  # vowel signs are letters
    if kind[0] not in "LN":
        return _SPLIT
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return ord("0") + digit
    low = c.lower().replace("ß", "s").replace("ſ", "s")
    apart = unicodedata.normalize("NFD", low)
    if len(apart) > 1 and all(unicodedata.category(x)[0] == "M" for x in apart[1:]):
        low = apart
    plain = unicodedata.normalize("NFKD", low[:1])[:1] if unicodedata.decomposition(low[:1]).startswith("<") else low[:1]
    return ord(plain) if unicodedata.category(plain)[0] in "LN" else ord(low[:1])


class Letters:
    """Texts as one run of folded letters, each text followed by a 0; where texts and words begin."""

    def __init__(self, texts: list[str | None]):
        joined = "\n".join(t or "" for t in texts) + "\n"
        raw = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        for c in np.flatnonzero(np.bincount(raw, minlength=1))[:]:
            if not _known[c]:
                _folded[c], _known[c] = fold_letter(chr(c)), True
        codes = _folded[raw]
        lens = np.array([len(t or "") + 1 for t in texts], np.int64)
        stop = np.zeros(len(raw), bool)
        stop[np.cumsum(lens) - 1] = True
        seen = codes != _MARK  # accents neither count nor part words
        codes, raw, stop = codes[seen], raw[seen], stop[seen]
        solid = codes != _SPLIT
        blank = np.isin(raw, _BLANK) | stop
        last = np.maximum.accumulate(np.where(solid | blank, np.arange(len(raw)), -1))  # a word goes on over signs inside it
        prior = np.concatenate([[-1], last[:-1]])
        first = solid & (_dense[raw] | (prior < 0) | blank[np.maximum(prior, 0)])
        kept = solid | stop
        self.codes = codes[kept]
        self.ends = np.flatnonzero(stop[kept])
        self.begin = np.concatenate([[0], self.ends[:-1] + 1]).astype(np.int64)
        self.starts = np.flatnonzero(first[kept])

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="left")


class SuffixArray:
    """All suffixes of a shard, in order, and searches in it.

    Suffixes are sorted by a few letters packed into a number, then, as long as
    some are equal, by the ranks of what follows, which doubles the letters
    compared each round, until ``depth`` letters are: no search needs the order
    of suffixes that share more, since each of these is followed by itself.  A 0
    ends a text; what follows it is never compared.
    """

    def __init__(self, letters: Letters, depth: int = SEED):
        present = np.zeros(_POINTS, bool)
        present[letters.codes] = True
        present[0] = False
        used = np.flatnonzero(present)
        self.rank_of = np.full(_POINTS, len(used) + 1, np.uint32)  # letters the shard lacks
        self.rank_of[used] = np.arange(1, len(used) + 1)
        self.rank_of[0] = 0
        self.bits = (len(used) + 1).bit_length()
        self.wide = max(1, 42 // self.bits)
        self.letters, self.n = letters, len(letters.codes)
        self.codes = self.rank_of[letters.codes]
        self.keys = self.pack(self.codes)
        self._sort(depth)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """``wide`` letters from each place as one number, in the order of the letters; nothing counts after a 0."""
        out = np.zeros(len(codes) + self.wide, np.uint64)
        more = np.concatenate([codes, np.zeros(self.wide, codes.dtype)]).astype(np.uint64)
        alive = np.ones(len(codes), bool)
        for j in range(self.wide):
            c = more[j : j + len(codes)]
            alive &= c != 0
            out[: len(codes)] = out[: len(codes)] << np.uint64(self.bits) | np.where(alive, c, 0).astype(np.uint64)
        return out

    def _sort(self, depth: int) -> None:
        at = np.flatnonzero(self.codes)
        keys = self.keys[at]
        room = max(1, self.n.bit_length())
        if self.wide * self.bits + room <= 64:
            both = np.sort(keys << np.uint64(room) | at.astype(np.uint64))
            order = (both & np.uint64((1 << room) - 1)).astype(np.int64)
            keys = both >> np.uint64(room)
        else:
            by = np.argsort(keys, kind="stable")
            order, keys = at[by], keys[by]
        self.sorted = keys
        head = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        rank = np.zeros(self.n + 1, np.int64)  # 1 + the place of the group's head; 0 at the end of a text
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0)) + 1
        done = self.wide
        open_ = np.flatnonzero(~head | ~np.concatenate([head[1:], [True]])) if len(head) else np.zeros(0, np.int64)
        while len(open_) and done < depth:
            arr = order[open_]
            g, nxt = rank[arr], rank[np.minimum(arr + done, self.n)]
            nxt[(arr + done) > self.n] = 0
            if 3 * room <= 63:
                both = np.sort((g.astype(np.uint64) << np.uint64(2 * room)) | (nxt.astype(np.uint64) << np.uint64(room)) | np.arange(len(arr), dtype=np.uint64))
                by = (both & np.uint64((1 << room) - 1)).astype(np.int64)
            else:
                by = np.lexsort((nxt, g))
            arr, g, nxt = arr[by], g[by], nxt[by]
            order[open_] = arr
            head = np.concatenate([[True], (g[1:] != g[:-1]) | (nxt[1:] != nxt[:-1])])
            rank[arr] = open_[np.maximum.accumulate(np.where(head, np.arange(len(arr)), 0))] + 1
            # equal ones whose texts both end here stay equal
            more = (~head | ~np.concatenate([head[1:], [True]])) & (nxt > 0)
            open_ = open_[more]
            done *= 2
        self.order = order

    def _narrow(self, lo, hi, wanted, at: int, shift):
        """Of the suffixes lo..hi, which share ``at`` letters, those whose next letters are the wanted ones."""
        out = []
        for right in (False, True):
            a, b = lo.copy(), hi.copy()
            while True:
                todo = np.flatnonzero(a < b)
                if not len(todo):
                    break
                mid = (a[todo] + b[todo]) >> 1
                have = self.keys[self.order[mid] + at] >> shift[todo]
                below = have <= wanted[todo] if right else have < wanted[todo]
                a[todo] = np.where(below, mid + 1, a[todo])
                b[todo] = np.where(below, b[todo], mid)
            out.append(a)
        return out

    def ranges(self, keys: np.ndarray, at: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every test suffix (its place in ``keys``, packed by ``pack``): where the suffixes lie that share its first ``need`` letters."""
        short = lambda d: (np.maximum(0, d + self.wide - need) * self.bits).astype(np.uint64)
        q, s = keys[at], short(0)
        lo = np.searchsorted(self.sorted, (q >> s) << s, "left")
        hi = np.searchsorted(self.sorted, ((q >> s) << s) + (np.uint64(1) << s) - np.uint64(1), "right")
        d = self.wide
        while True:
            go = np.flatnonzero((need > d) & (lo < hi))
            if not len(go):
                return lo, hi
            s = short(d)[go]
            lo[go], hi[go] = self._narrow(lo[go], hi[go], keys[at[go] + d] >> s, d, s)
            d += self.wide

    def common(self, codes: np.ndarray, keys: np.ndarray, at: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """How many letters from ``at`` of the test and from ``pos`` of the shard agree, before either text ends."""
        out, go = np.zeros(len(at), np.int64), np.arange(len(at))
        while len(go):
            x, y = at[go] + out[go], pos[go] + out[go]
            # a packed number whose last letter is no 0 holds no end
            same = (keys[x] == self.keys[y]) & ((keys[x] & np.uint64((1 << self.bits) - 1)) != 0)
            out[go[same]] += self.wide
            rest = go[~same]
            for _ in range(self.wide):
                x, y = at[rest] + out[rest], pos[rest] + out[rest]
                rest = rest[(codes[x] == self.codes[y]) & (codes[x] != 0)]
                if not len(rest):
                    break
                out[rest] += 1
            go = go[same]
        return out


class Items:
    """The evaluation passages of a block, ready for searching."""

    def __init__(self, ids: list, passages: list[str | None], least_words: int = 1):
        self.ids, self.letters = ids, Letters(passages)
        l = self.letters  # noqa: E741
        words = np.searchsorted(l.starts, l.ends) - np.searchsorted(l.starts, l.begin)
        size = l.ends - l.begin
        self.dense = size < 2 * words
        at = np.flatnonzero(l.codes)
        item = l.text_of(at)
        need = np.where(self.dense[item], SEED_DENSE, SEED)
        fits = (l.ends[item] - at >= need) & (words[item] >= least_words)
        self.at, self.item, self.need = at[fits], item[fits], need[fits]

    def passage(self, i: int, codes: np.ndarray, bits: int) -> Passage:
        a, b, s = self.letters.begin[i], self.letters.ends[i], self.letters.starts
        gram = max(1, min(2 if self.dense[i] else 6, 62 // bits))
        return Passage(codes[a:b], s[np.searchsorted(s, a) : np.searchsorted(s, b)] - a, gram, bits)


class Passage:
    """One passage's letters, word starts and sorted grams."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, gram: int = 6, bits: int = 6):
        self.codes, self.starts, self.gram, self.bits = codes, starts, gram, bits
        grams = _grams(codes, gram, bits)
        self.order = np.argsort(grams, kind="stable")
        self.grams = grams[self.order]
        self.bounds = np.maximum(1, np.diff(np.concatenate([starts, [len(codes)]])))


def matches(items: Items, shard: SuffixArray, codes: np.ndarray) -> dict[str, np.ndarray]:
    """Every longest verbatim match of at least the seed's letters: item, text, place in the passage, place in the text, letters.

    Every suffix of every passage is looked up by binary search; of the suffixes
    that share its first letters those count which the letter before does not
    prolong to the left, and each is followed as far to the right as it goes.
    ``codes`` are the passages' letters as ranks of the shard.
    """
    keys = shard.pack(codes)
    lo, hi = shard.ranges(keys, items.at, items.need)
    some = np.flatnonzero(lo < hi)
    found: list[tuple] = []
    n = (hi - lo)[some]
    cut = 0
    while cut < len(some):
        upto = int(np.searchsorted(np.cumsum(n[cut:]), _PAIRS, "right")) + cut
        upto = max(upto, cut + 1)
        m = n[cut:upto]
        which = np.repeat(some[cut:upto], m)
        pos = shard.order[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[some[cut:upto]], m)]
        at = items.at[which]
        before = np.where(at > 0, codes[at - 1], 0)
        prior = np.where(pos > 0, shard.codes[pos - 1], 0)
        left = (before == 0) | (before != prior)
        which, pos, at = which[left], pos[left], at[left]
        found.append((items.item[which], shard.letters.text_of(pos), at - items.letters.begin[items.item[which]], pos, shard.common(codes, keys, at, pos)))
        cut = upto
    cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 5
    return dict(zip(("item", "text", "place", "pos", "letters"), cols))


def _price(gap, off, over):
    """What it costs to go on in the passage ``gap`` letters further, at another shift, over foreign letters."""
    far = np.abs(off)
    return 0.2 * np.maximum(gap, 0) + np.where(far <= 3, 1.0 + 0.5 * far, np.where(far <= 400, 9.0 + 0.01 * far, 13.0 + 4.0 * np.log2(np.maximum(far, 400) / 400.0))) + over


def chain_scores(heads: np.ndarray, place: np.ndarray, pos: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of every group of matches (sorted by place): the letters of its best chain in the order of both texts, less the prices of going on."""
    out = np.zeros(len(heads))
    n = np.diff(np.concatenate([heads, [len(place)]]))
    by_size = np.argsort(n, kind="stable")
    cut = 0
    while cut < len(heads):
        upto = cut + 1
        while upto < len(heads) and n[by_size[upto]] * (upto + 1 - cut) <= 100_000:
            upto += 1
        some = by_size[cut:upto]
        m = int(n[some].max())
        real = np.arange(m) < n[some][:, None]
        at = np.where(real, heads[some][:, None] + np.arange(m), 0)
        p, t, l = place[at], pos[at], np.where(real, size[at], 0)  # noqa: E741
        score, shift, end = l.astype(np.float64), t - p, p + l
        for j in range(1, m):
            gap = p[:, j, None] - end[:, :j]
            over = np.maximum(0, -gap)
            ok = (end[:, :j] < end[:, j, None]) & (t[:, :j] < t[:, j, None]) & (t[:, j, None] - (t[:, :j] + l[:, :j]) + over >= 0)
            through = np.where(ok, score[:, :j] - _price(gap, shift[:, j, None] - shift[:, :j], over), 0.0).max(1)
            score[:, j] += np.where(real[:, j], np.maximum(through, 0.0), 0.0)
        out[some] = score.max(1)
        cut = upto
    return out


def candidates(items: Items, m: dict[str, np.ndarray]) -> list[tuple[int, int, int]]:
    """(item, text, longest) where a chain of verbatim matches makes up enough letters of the passage."""
    if not len(m["item"]):
        return []
    top = int(m["text"].max()) + 1
    group = m["item"].astype(np.int64) * top + m["text"]
    o = np.lexsort((m["pos"], m["place"], group))
    group, place, pos, size = group[o], m["place"][o], m["pos"][o], m["letters"][o]
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.where(items.dense[group[heads] // top], CHAIN_DENSE, CHAIN)
    enough = np.add.reduceat(size, heads) >= least  # a chain holds no more than all matches
    n = np.diff(np.concatenate([heads, [len(group)]]))
    kept = np.repeat(enough, n)
    group, place, pos, size, least = group[kept], place[kept], pos[kept], size[kept], least[enough]
    if not len(group):
        return []
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ok = chain_scores(heads, place, pos, size) >= least
    item, text, longest = group[heads] // top, group[heads] % top, np.maximum.reduceat(size, heads)
    return list(zip(item[ok].tolist(), text[ok].tolist(), longest[ok].tolist()))


def _grams(codes: np.ndarray, gram: int, bits: int) -> np.ndarray:
    n = max(0, len(codes) - gram + 1)
    out = np.zeros(n, np.int64)
    for i in range(gram):
        out = out << bits | codes[i : i + n]
    return out


def _slips(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(slips, letters): the fewest lost, added or other letters between ``a`` and a beginning of ``b``, and its length."""
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        new = np.concatenate([[i], best])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))  # added letters
    k = int(np.argmin(row))
    return int(row[k]), k


def _end_words(passage: Passage, text: np.ndarray, word: int, place: int, at: int, step: int, most: int = 2) -> int:
    """How many words from ``word`` on (step 1) or back (step -1) go on in the text from the last recognised letter
    (``place`` of the passage, ``at`` of the text), each with a third of its letters misread, lost or added at most."""
    ends = np.concatenate([passage.starts, [len(passage.codes)]])
    n = 0
    while n < most and 0 <= word < len(passage.starts):
        a, b = (place, ends[word + 1]) if step > 0 else (ends[word], place)
        mine = passage.codes[a:b]
        whole = int(ends[word + 1] - ends[word])
        room = len(mine) + 3
        theirs = text[at : at + room] if step > 0 else text[max(0, at - room) : at]
        if step < 0:
            mine, theirs = mine[::-1], theirs[::-1]
        if len(mine):
            slips, k = _slips(mine, theirs)
            if slips * 3 > whole:
                return n + _after_lines(passage, text, word, at, step, most - n)
            at += step * k
        place = b if step > 0 else a
        n, word = n + 1, word + step
    return n


def _after_lines(passage: Passage, text: np.ndarray, word: int, at: int, step: int, most: int, letters: int = 200) -> int:
    """How many words from ``word`` on (or back) stand, letter by letter, beyond foreign lines of the next ``letters``."""
    ends = np.concatenate([passage.starts, [len(passage.codes)]])
    for k in range(most, 0, -1):
        a, b = (word, word + k) if step > 0 else (word - k + 1, word + 1)
        if a < 0 or b > len(passage.starts):
            continue
        mine = passage.codes[ends[a] : ends[b]].astype("<u4").tobytes()
        room = (text[at : at + letters] if step > 0 else text[max(0, at - letters) : at]).astype("<u4").tobytes()
        if len(mine) >= 4 * 4 and any(room[x : x + len(mine)] == mine for x in range(0, len(room) - len(mine) + 1, 4)):
            return k
    return 0


def running_words(passage: Passage, text: np.ndarray, enough: int = 0) -> tuple[int, float, int, float]:
    """(words, share, letters, net): the longest stretch of running words of the passage in the text.

    Short verbatim pieces of both are chained in order; within a chain letters
    may be misread, lost or added, and foreign lines of any length may stand
    between its pieces, each at a price that grows ever more slowly with their
    letters.  Of the words the best chain covers, the stretch is taken in which
    covered words most outweigh missing ones; a misread word at either end is
    added where the text goes on with it.  words is its length, share the part of
    it that is recognised, letters the covered letters of the passage, net these less the
    prices as a part of the letters of the stretch (scattered stock phrases pay for their jumps).
    """
    starts, letters_of = passage.starts, len(passage.codes)
    gt, sp = _grams(text, passage.gram, passage.bits), passage.grams
    if not len(sp) or not len(gt) or not len(starts):
        return 0, 0.0, 0, 0.0
    lo = np.searchsorted(sp, gt, "left")
    some = np.flatnonzero(sp[np.minimum(lo, len(sp) - 1)] == gt)
    lo = lo[some]
    n = np.searchsorted(sp, gt[some], "right") - lo
    t = np.repeat(some, n)
    p = passage.order[np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    if not len(p):
        return 0, 0.0, 0, 0.0
    diag = t - p
    o = np.lexsort((p, diag))
    p, diag = p[o], diag[o]
    cut = np.flatnonzero(np.concatenate([[True], (diag[1:] != diag[:-1]) | (p[1:] != p[:-1] + 1)]))
    size = np.diff(np.concatenate([cut, [len(p)]])) + passage.gram - 1
    a, d = p[cut], diag[cut]
    o = np.argsort(a, kind="stable")
    a, d, size = a[o], d[o], size[o]
    end, m = a + size, len(a)
    share_of = lambda covered: np.add.reduceat(covered, starts) / passage.bounds
    if enough:  # all pieces together bound what any chain of them covers
        edge = np.zeros(letters_of + 1, np.int64)
        np.add.at(edge, a, 1)
        np.add.at(edge, end, -1)
        if (share_of(np.cumsum(edge)[:-1] > 0) >= 0.5).sum() < enough:
            return 0, 0.0, 0, 0.0
    score, back = size.astype(np.float64), np.full(m, -1)
    for j0 in range(0, m, 256):  # the gain of reaching piece j from piece i, for 256 pieces at once
        js = np.arange(j0, min(m, j0 + 256))
        i0 = int(np.searchsorted(a, a[j0] - 160))
        gap = a[js, None] - end[None, i0 : js[-1] + 1]
        off = d[js, None] - d[None, i0 : js[-1] + 1]
        tgap = gap + off  # letters of the text between the pieces
        over, far = np.maximum(-gap, 0), np.abs(off)
        gain = -(0.7 * np.maximum(gap, 0) + np.where(far <= 3, 1.0 + 0.5 * far, np.where(far <= 400, 9.0 + 0.01 * far, 13.0 + 4.0 * np.log2(np.maximum(far, 400) / 400.0))) + over)
        ok = (gap >= -24) & (gap <= 45) & (tgap >= -24) & (tgap + over >= 0) & (end[None, i0 : js[-1] + 1] < end[js, None])
        gain[~ok] = -np.inf
        for r, j in enumerate(js):
            if j > i0:
                v = score[i0:j] + gain[r, : j - i0]
                b = int(v.argmax())
                if v[b] > 0:
                    score[j] += v[b]
                    back[j] = i0 + b
    j = int(np.argmax(score))
    covered = np.zeros(letters_of, bool)
    where = np.full(letters_of, -1)  # of every covered letter: its place in the text
    while j >= 0:
        covered[a[j] : end[j]] = True
        where[a[j] : end[j]] = np.arange(a[j], end[j]) + d[j]
        j = back[j]
    letters = int(covered.sum())
    hit = share_of(covered) >= 0.5
    if not hit.any():
        return 0, 0.0, letters, 0.0
    sums = np.concatenate([[0.0], np.cumsum(np.where(hit, 1.0, -2.5))])
    lowest = np.minimum.accumulate(sums)
    stop = int(np.argmax(sums - lowest))
    begin = int(np.flatnonzero(sums[: stop + 1] == lowest[stop])[-1])
    words, known = stop - begin, int(hit[begin:stop].sum())
    inside = np.flatnonzero(covered[starts[begin] : starts[stop] if stop < len(starts) else letters_of]) + starts[begin]
    first, last = int(inside[0]), int(inside[-1])
    more = _end_words(passage, text, begin - 1, first, int(where[first]), -1) + _end_words(passage, text, stop, last + 1, int(where[last]) + 1, 1)
    whole = int(passage.bounds[begin:stop].sum())
    return words + more, (known + more) / max(words + more, 1), letters, float(score.max()) / max(whole, 1)


_OUT = "words int, share double, longest int, letters int"

_blocks: dict[tuple, Items] = {}


def _block(file: str, least_words: int) -> Items:
    """The items of one shared file, prepared; the last KEPT_BLOCKS are kept."""
    key = (file, least_words)
    if key not in _blocks:
        import pyarrow.parquet as pq
        from pyspark import SparkFiles

        t = pq.read_table(SparkFiles.get(file))
        while len(_blocks) >= KEPT_BLOCKS:
            _blocks.pop(next(iter(_blocks)))
        _blocks[key] = Items(t.column(0).to_pylist(), t.column(1).to_pylist(), least_words)
    return _blocks[key]


def _search(id_type: pa.DataType, item_type: pa.DataType, files: list[str], id_name: str, item_name: str, least_words: int, least_share: float, least_net: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enough = int((least_words - 2) * least_share)

        def shard(ids: list, texts: list) -> Iterator[pa.RecordBatch]:
            letters, index = Letters(texts), None
            for file in files:
                items = _block(file, least_words)
                if not len(items.at):
                    continue
                index = index or SuffixArray(letters)
                codes = index.rank_of[items.letters.codes]
                rows = []
                for i, d, longest in candidates(items, matches(items, index, codes)):
                    passage = items.passage(i, codes, index.bits)
                    words, share, covered, net = running_words(passage, index.codes[letters.begin[d] : letters.ends[d]], enough)
                    if words >= least_words and share >= least_share and net >= least_net:
                        rows.append((ids[d], items.ids[i], words, share, longest, covered))
                if rows:
                    c = list(zip(*rows))
                    kinds = (id_type, item_type, pa.int32(), pa.float64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(c, kinds)], names=[id_name, item_name, "words", "share", "longest", "letters"])

        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if ids and size + len(t or "") > SHARD_LETTERS:
                    yield from shard(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t or "")
        if ids:
            yield from shard(ids, texts)

    return run


def _shared_items(items: DataFrame, item_col: str, passage_col: str, shelf: Shelf) -> list[str]:
    """The items as files of ITEM_BLOCK rows in the shared folder, which Spark hands to every executor once."""
    spark = items.sparkSession
    some = items.select(F.col(item_col).alias("i"), F.col(passage_col).cast("string").alias("p")).filter(F.col("p").isNotNull())
    where = f"{shelf.root}/items"
    some.coalesce(1).write.option("maxRecordsPerFile", ITEM_BLOCK).parquet(where)
    names = []
    for f in shelf.fs.listStatus(shelf._path(where)):
        if f.getPath().getName().endswith(".parquet"):
            spark.sparkContext.addFile(f.getPath().toString())
            names.append(f.getPath().getName())
    return sorted(names)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", least_words: int = 25, least_share: float = 0.88, least_net: float = 0.55) -> DataFrame:
    """(doc, item, words, share, longest, letters): documents that hold a passage, wholly or in part.

    Every row of ``docs`` is searched whole for every passage.  Case, accents,
    punctuation, spaces and line ends do not count: texts are runs of letters and
    digits of any script; in scripts without spaces every letter is a word.
    Null and blank texts or passages match nothing, nor does a passage of fewer
    than ``least_words`` words; texts of any length are read; repeated rows are
    each searched; other columns are ignored; empty tables give an empty result.

    Each task turns its documents into suffix arrays of about SHARD_LETTERS
    letters and looks every suffix of every passage up by binary search, which
    gives the longest verbatim matches and their places (``longest`` is the
    longest of all); where those of one passage cover enough of it in one
    document, the document is read for running words, over misread letters and
    foreign lines.  At least ``least_words`` words, of which ``least_share`` are
    recognised, are a leak, if the letters of the chain less its prices are ``least_net`` of their letters.  The corpus is read once and not shuffled.  The items
    lie in files of ITEM_BLOCK rows that every executor fetches once.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship(spark)
    kind, item_kind = docs.schema[id_col].dataType, items.schema[item_col].dataType
    files = _shared_items(items, item_col, passage_col, Shelf(spark, "leaks"))
    run = _search(to_arrow_type(kind), to_arrow_type(item_kind), files, id_col, item_col, least_words, least_share, least_net)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, `{item_col}` {item_kind.simpleString()}, {_OUT}")


def without_leaks(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that hold no passage."""
    return docs.join(leaks.select(id_col).distinct(), id_col, "left_anti")
