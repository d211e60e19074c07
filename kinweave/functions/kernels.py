"""String similarities that Spark has no expression for, as plain functions for Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with up to four prefix letters weighted 0.1, where it exceeds 0.7; two empty strings give 0."""
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    m = len(hits)
    if not m:
        return 0.0
    turned = sum(x != y for x, y in zip(hits, (y for y, u in zip(b, used) if u))) // 2
    jaro = (m / len(a) + m / len(b) + (m - turned) / m) / 3
    if jaro <= 0.7:
        return jaro
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + 0.1 * same * (1 - jaro)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        u = row & where.get(y, 0)
        row = (row + u | row - u) & full
    return len(a) - bin(row).count("1")


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; two empty strings give 1."""
    return 2 * _common(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of the longer one."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    n = len(a)
    stretches = {b[max(0, i) : i + n] for i in range(1 - n, len(b))}
    return max(ratio(a, s) for s in stretches)


def _sorted(s: str) -> str:
    return " ".join(sorted(s.split()))


def _sets(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    return both, " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted(a), _sorted(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words and the shared words followed by either side's own."""
    both, x, y = _sets(a, b)
    if both and (not x or not y):
        return 1.0
    if not both and not (x and y):
        return 0.0
    p, q = f"{both} {x}".strip(), f"{both} {y}".strip()
    return max(ratio(p, q), *((ratio(both, p), ratio(both, q)) if both else (0.0,)))


def token_ratio(a: str, b: str) -> float:
    return max(token_sort_ratio(a, b), token_set_ratio(a, b))


def partial_token_sort_ratio(a: str, b: str) -> float:
    return partial_ratio(_sorted(a), _sorted(b))


def partial_token_set_ratio(a: str, b: str) -> float:
    both, x, y = _sets(a, b)
    if both:
        return 1.0
    return partial_ratio(x, y) if x and y else 0.0


def partial_token_ratio(a: str, b: str) -> float:
    return max(partial_token_sort_ratio(a, b), partial_token_set_ratio(a, b))


KERNELS = {
    "jaro_winkler": jaro_winkler, "basic_ratio": ratio, "partial_ratio": partial_ratio, "partial_ratio_alignment": partial_ratio,  # the score of the best alignment
    "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio,
    "token_ratio": token_ratio, "partial_token_sort_ratio": partial_token_sort_ratio, "partial_token_set_ratio": partial_token_set_ratio, "partial_token_ratio": partial_token_ratio,
}


def levenshtein(a: str, b: str) -> float:
    """1 less the edit distance over the greater length, columns of the table as bits; two empty strings are equal."""
    if not a or not b:
        return 0.0 if a or b else 1.0
    where: dict[str, int] = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full, high, score = (1 << len(b)) - 1, 1 << len(b) - 1, len(b)
    up, down = full, 0
    for x in a:
        same = where.get(x, 0)
        across = ((same & up) + up ^ up | same) & full
        more, less = (down | ~(across | up)) & full, up & across
        score += bool(more & high) - bool(less & high)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | ~(same | down | more) & full, more & (same | down)
    return 1.0 - score / max(len(a), len(b))


#: Rows compared at once, few enough for a processor's cache; letters of a machine word; entries of a table of places.
ROWS_AT_ONCE, WORD, TABLE = 8_192, 64, 4_000_000


def _codes(words: list[str], width: int) -> np.ndarray:
    """Letters of the words as numbers, a row a word, filled up or cut to the width."""
    return np.array([w[:width] for w in words], dtype=f"U{width}").view(np.uint32).reshape(len(words), width)


def _places(ys: list[str], letters: np.ndarray, width: int, word: type) -> np.ndarray:
    """Bits of the places that hold a letter, a row a letter; the last row, for no letter, is empty."""
    codes, there = _codes(ys, width), np.arange(width) < np.array([len(y) for y in ys])[:, None]
    if codes.max() < 256:
        codes = codes.astype(np.uint8)
    filled, out = not there.all() and bool((codes == 0)[there].any()), np.zeros((len(letters) + 1, len(ys)), word)
    for k, c in enumerate(letters.tolist()):
        if c < 256 or codes.dtype != np.uint8:
            same = codes == codes.dtype.type(c)
            if filled or not c:
                same &= there
            out[k] = np.packbits(same.reshape(-1), bitorder="little").view(word)
    return out


def _at_once(f: Callable[[str, str], float], compare: Callable) -> Callable:
    """Scores many pairs of listed words; pairs with a word beyond a machine word go to ``f``, the others to ``compare``.

    It gets both lengths, a function of k that tells at which places each right
    has its left's letter k, as bits, and the type of these.
    """

    def many(xs: list[str], ys: list[str], cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
        out, nx, ny = np.zeros(len(cx)), np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
        far = (nx[cx] > WORD) | (ny[cy] > WORD)
        out[far] = [f(xs[i], ys[j]) for i, j in zip(cx[far].tolist(), cy[far].tolist())]
        near = np.flatnonzero(~far)
        if not len(near):
            return out
        width, word = (64, np.uint64) if ny[cy[near]].max() > 32 else (32, np.uint32)
        codes, there = _codes(xs, WORD), np.arange(WORD) < nx[:, None]
        letters = np.unique(codes[there])
        rows_each = ROWS_AT_ONCE if (len(letters) + 1) * len(ys) <= TABLE else max(1, TABLE // (len(letters) + 1))
        table = None
        for k in range(0, len(near), rows_each):
            rows = near[k : k + rows_each]
            i, j, some = cx[rows], cy[rows], ys
            if rows_each != ROWS_AT_ONCE:  # a table of these rows' rights only
                listed, j = np.unique(j, return_inverse=True)
                some, table = [ys[y] for y in listed.tolist()], None
            if table is None:
                table = _places(some, letters, width, word).reshape(-1)
                start = (np.where(there, np.searchsorted(letters, codes), len(letters)) * len(some)).T
            out[rows] = compare(nx[i], ny[cy[rows]], lambda place: table.take(start[place].take(i) + j), word)  # noqa: B023
        return out

    return many


@lru_cache(maxsize=None)
def _window(place: int, size: int) -> np.ndarray:
    """Bits of the places at most ``reach`` from a place, by reach."""
    return np.array([((1 << min(size, place + r + 1)) - 1) & ~((1 << max(0, place - r)) - 1) & (1 << size) - 1 for r in range(WORD)], np.uint32 if size == 32 else np.uint64)


def _jaro_winkler_at_once(nx: np.ndarray, ny: np.ndarray, bits: Callable, word: type) -> np.ndarray:
    one, none, size = word(1), word(0), 8 * np.dtype(word).itemsize
    reach = np.maximum(0, np.maximum(nx, ny) // 2 - 1)
    alike = reach[0] if (reach == reach[0]).all() else None
    free, hits, letters = np.full(len(nx), ~none), [], []
    for k in range(int(nx.max())):
        letter = bits(k)
        found = letter & (_window(k, size).take(reach) if alike is None else _window(k, size)[alike])
        found &= free
        found &= ~found + one
        free ^= found
        letters.append(letter)
        hits.append(found)
    rest = ~free
    m, turned = np.bitwise_count(rest).astype(np.int64), np.zeros(len(nx), np.uint8)
    for found, letter in zip(hits, letters):
        if found.any():
            first = rest & ~rest + one
            first *= found != none
            rest ^= first
            letter &= first
            turned += letter != first
    jaro = np.where(m > 0, (m / np.maximum(nx, 1) + m / np.maximum(ny, 1) + (m - turned // 2) / np.maximum(m, 1)) / 3, 0.0)
    close = np.flatnonzero(jaro > 0.7)
    same, equal = np.zeros(len(close), np.int64), np.ones(len(close), bool)
    for k in range(min(4, len(letters))):
        equal &= (bits(k)[close] >> word(k) & one).astype(bool)
        same += equal
    jaro[close] += 0.1 * same * (1 - jaro[close])
    return jaro


def _levenshtein_at_once(nx: np.ndarray, ny: np.ndarray, bits: Callable, word: type) -> np.ndarray:
    one, none = word(1), word(0)
    up, down = np.full(len(nx), ~none), np.zeros(len(nx), word)
    last, score, least = np.maximum(ny - 1, 0).astype(word), ny.astype(np.int64), int(nx.min())
    for k in range(int(nx.max())):
        same = bits(k)
        across = same & up
        across += up
        across ^= up
        across |= same
        more, less = down | ~(across | up), up & across
        step = (more >> last & one).astype(np.int8) - (less >> last & one).astype(np.int8)
        score += step if k < least else np.where(k < nx, step, 0)
        more = more << one | one
        same |= down
        up = less << one | ~(same | more)
        down = more & same
    longest = np.maximum(nx, ny)
    score = np.where(ny == 0, nx, score)
    return np.where(longest == 0, 1.0, 1.0 - score / np.maximum(longest, 1))


#: Kernels that score the value pairs of a batch at once.
MANY = {"jaro_winkler": _at_once(jaro_winkler, _jaro_winkler_at_once), "levenshtein": _at_once(levenshtein, _levenshtein_at_once)}


def by_value_pairs(x: pa.Array, y: pa.Array, f: Callable[[str, str], float], many: Callable | None = None) -> pa.Array:
    """``f`` of two text columns, null where either is; equal value pairs of the batch are scored once."""
    there = np.asarray(x.is_valid()) & np.asarray(y.is_valid())
    out = np.zeros(len(x))
    if there.any():
        keep = pa.array(there)
        x, y = x.filter(keep).dictionary_encode(), y.filter(keep).dictionary_encode()
        cx, cy = x.indices.to_numpy().astype(np.int64), y.indices.to_numpy().astype(np.int64)
        xs, ys = x.dictionary.to_pylist(), y.dictionary.to_pylist()
        if many:
            out[there] = many(xs, ys, cx, cy)
        else:
            pairs, back = np.unique(cx * len(ys) + cy, return_inverse=True)
            out[there] = np.array([float(f(xs[k // len(ys)], ys[k % len(ys)])) for k in pairs.tolist()])[back]
    return pa.array(out, mask=~there)
