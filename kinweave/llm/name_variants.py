"""Linking the many spellings under which one person or organisation appears.

Merge-and-rematch resolution: every spelling is read into its parts (surname,
given name or initial, generation; or an organisation's own name and trade);
profiles that certainly mean one bearer are merged, which unions their
surnames, given names and initials; the richer profiles enter blocking again,
until no merge happens.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kinweave.operators.closure import linked_pairs
from kinweave.operators.components import components_in_one_task, connected_components
from kinweave.runtime import SMALL_ROWS, Shelf, rows_of, ship, skew_lookup

#: Given names with their short and pet forms. Fixed values; another list may be passed.
GIVEN_NAMES: dict[str, tuple[str, ...]] = {
    "adele": (), "adolf": (), "agnes": (), "albert": (), "albrecht": (), "alexander": ("alex",), "alfred": (), "alma": (), "alois": (), "amalie": ("malchen",), "andreas": ("andres",), "anna": ("anne", "anni", "änne"), "anton": ("toni",),
    "antonie": (), "arnold": (), "arthur": (), "august": (), "auguste": ("guste",), "bernhard": ("bernd",), "bertha": ("berta",), "bruno": (), "charlotte": ("lotte",), "christian": ("chris",), "christine": ("stine",), "clemens": ("klemens",),
    "daniel": (), "david": (), "dietrich": ("dieter",), "dorothea": ("thea", "dora"), "edmund": (), "eduard": ("edi",), "eleonore": ("lore",), "elisabeth": ("else", "liesel", "lisbeth", "elise"), "emil": (), "emilie": (), "emma": (), "erich": (),
    "erna": (), "ernst": (), "eugen": (), "eva": (), "felix": (), "ferdinand": (), "franz": (), "franziska": ("fanny", "franzi"), "frieda": (), "friederike": ("rike",), "friedrich": ("fritz",), "georg": ("jörg", "schorsch"), "gerhard": ("gerd",),
    "gertrud": ("trude",), "gottfried": (), "gottlieb": (), "gregor": (), "gustav": (), "hedwig": ("hede",), "heinrich": ("heinz", "heiner"), "helene": ("lene",), "henriette": ("jette",), "hermann": (), "hermine": (), "hubert": (), "hugo": (),
    "ida": (), "ignaz": (), "irma": (), "jakob": (), "joachim": ("jochen", "achim"), "johann": ("hans", "johannes"), "johanna": ("hanna", "hanne"), "josef": ("sepp", "joseph", "jupp"), "josephine": ("fine",), "julie": (), "julius": (),
    "karl": ("carl",), "karoline": ("caroline", "lina"), "kaspar": (), "katharina": ("käthe", "kaethe", "kathi", "trine"), "klara": ("clara",), "konrad": ("kurt",), "laura": (), "leo": (), "leonhard": (), "leopold": ("poldi",), "lorenz": ("lenz",),
    "luise": ("louise",), "ludwig": ("lutz",), "magdalena": ("magda", "leni"), "margarethe": ("grete", "gretchen"), "maria": ("marie", "mizzi"), "martha": (), "martin": (), "mathilde": ("tilde", "thilde"), "matthias": (), "maximilian": ("max",),
    "michael": ("michel",), "moritz": (), "nikolaus": ("klaus",), "olga": (), "oskar": (), "oswald": (), "ottilie": ("tilly",), "otto": (), "paul": (), "pauline": ("paula",), "peter": (), "philipp": (), "quirin": (), "reinhard": (), "reinhold": (),
    "richard": (), "robert": (), "rosa": (), "rosine": (), "rudolf": ("rudi",), "samuel": (), "sebastian": ("bastian",), "siegfried": (), "siegmund": (), "simon": (), "sophie": ("fieke",), "stephan": ("steffen",), "theodor": ("theo",),
    "therese": ("resi",), "thomas": (), "ulrich": ("uli",), "ursula": ("ulla",), "valentin": (), "veronika": ("vroni",), "viktor": (), "viktoria": (), "vinzenz": (), "walter": (), "werner": (), "wilhelm": ("willy", "willi"),
    "wilhelmine": ("minna", "minchen"), "wolfgang": ("wolf",), "xaver": (), "zita": (),
}

#: Titles, callings and remarks that name nobody. Fixed values.
TITLES = frozenset("dr prof jur phil med ing geh komm kommerzienrat justizrat rat rentner rentier bankier direktor ebenda hier geb geborene verw fruher vorm vormals gen genannt herr frau witwe dipl".split())

#: How a generation is written. Fixed values.
GENERATIONS = {**dict.fromkeys("jun jr junior jungere jungerer sohn".split(), "J"), **dict.fromkeys("sen sr senior altere alterer vater".split(), "S")}

#: Words and letters of legal forms, German and others. Fixed values.
LEGAL = frozenset(
    "ag aktiengesellschaft gesellschaft actien aktien akt act ges gmbh kgaa kg ohg kommanditgesellschaft genossenschaft eingetragene eingetr gen egen haftung beschrankter beschrankte auf mit gebruder "
    "inc ltd limited llc llp plc corp corporation company incorporated sarl sas spa srl snc bv nv oyj aps".split()
)
#: Legal forms written in single letters, which count where nothing else of a name follows. Fixed values.
LETTERED = frozenset("ag gmbh kgaa kg eg ohg bv nv sa spa srl ab as oy".split())

#: What words for a trade or an establishment end in. Fixed values (German word formation).
TRADE_HEADS = (
    "werk", "werke", "fabrik", "fabriken", "erei", "ereien", "anstalt", "bank", "bahn", "gesellschaft", "hutte", "grube", "zeche", "gewerkschaft", "versicherung", "schiffahrt", "schifffahrt", "manufaktur", "verein", "verlag", "muhle", "muhlen", "handlung", "raffinerie",
    "kasse", "reederei", "apotheke",
)

#: Letters of scripts written without spaces, where one word may be a whole name. Fixed values (Unicode blocks).
_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\u1100-\u11ff\uac00-\ud7ff]")
_TOKEN = re.compile(r"[^\W\d_]+")
_PARTICLES = ("von", "van", "der", "d", "die", "zu", "u", "und")
#: Up to so many edges of a round are joined into components by one task.
ONE_TASK_EDGES = 500_000
#: The most words of roles that are taken to the tasks.
MOST_ROLES = 200_000
#: A listed given name that is so many times as usual as a word one or two letters off makes the word its slip.
SLIP_TIMES = 100


def fold_name(s: str) -> str:
    s = unicodedata.normalize("NFC", s).lower().replace("ß", "ss").replace("ſ", "s").replace("0", "o").replace("1", "l")
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def plain_sound(s: str) -> str:
    """A spelling without what clerks write at will: doubled letters, y/i, ph/f, th/t, ck/k, dt/t; and rn read as m."""
    for a, b in (("rn", "m"), ("ph", "f"), ("th", "t"), ("ck", "k"), ("kh", "ch"), ("dt", "t"), ("y", "i"), ("ie", "i")):
        s = s.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", s)


def near(a: str, b: str, most: int) -> bool:
    """Whether two words are at most ``most`` slips (one letter more, less, other, or two turned round) apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most or max(len(set(a) - set(b)), len(set(b) - set(a))) > most:
        return False
    before2, before = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before2[j - 2] + 1)
            row.append(v)
        before2, before = before, row
    return before[-1] <= most


def _without(w: str, most: int) -> set[str]:
    """A word with up to ``most`` letters left out."""
    out = {w}
    for _ in range(most):
        out |= {x[:i] + x[i + 1 :] for x in out for i in range(len(x))}
    return out


class Slips:
    """Words found again in spite of slips, by the letters left when some are left out of both."""

    def __init__(self, words, two_from: int, least: int = 4):
        self.two_from, self.least, self.index, self.longest = two_from, least, {}, 0
        for w in words:
            self.add(w)

    def add(self, w: str) -> None:
        if len(w) >= self.least:
            self.longest = max(self.longest, len(w))
            for x in _without(w, self.most(w)):
                self.index.setdefault(x, []).append(w)

    def most(self, w: str) -> int:
        return 2 if len(w) >= self.two_from else 1

    def near(self, t: str) -> list[tuple[int, bool, str]]:
        """(slips, whether the first letter is one, word) of the words that ``t`` may be, the nearest first."""
        if len(t) > self.longest + 2:
            return []
        met = {w for x in _without(t, 2 if len(t) >= self.two_from - 2 else 1) for w in self.index.get(x, ())}
        return sorted((next(k for k in (0, 1, 2) if near(t, w, k)), w[0] not in t[:2], w) for w in met if near(t, w, self.most(w)))


def _shortens(parts: list[str], word: str) -> bool:
    """Whether the parts, one after the other, may be what is left of a longer word: beginnings of its parts, or its main letters."""
    first = parts[0]
    if len(first) < 2 or not word.startswith(first[:2]) or sum(map(len, parts)) >= len(word):
        return False
    at = 0
    for n, p in enumerate(parts):
        if n == 0 and word.startswith(p):
            at = len(p)
            continue
        for k, c in enumerate(p):
            hit = word.find(c, at)
            if hit < 0 or (n == 0 and k < 3 and hit != k):
                return False
            at = hit + 1
    return True


class Roles(NamedTuple):
    """Words of a column by what they do in its names: trades (the most usual first) with the rows that hold them, and remarks that name nobody."""

    trades: tuple[tuple[str, int], ...] = ()
    remarks: tuple[str, ...] = ()


class NameReader:
    """Reads a typed name into (kind, own, first, pre, gen, trade).

    kind is P (person), F (organisation of a known trade) or W (a name whose
    words have no known role, or an organisation of no known trade); own is the
    surname in plain sound, of F and W all words that are no trade, remark or
    legal form, in order of letters; first is a known given name, pre the letters
    of a shortened one; gen is J, S or empty; trade the trade or empty.  Words of
    any script are read.
    """

    def __init__(self, given: dict[str, tuple[str, ...]] = GIVEN_NAMES, frequent: tuple[str, ...] = (), roles: Roles = Roles()):
        self.trades = dict(roles.trades)
        self.remarks = set(roles.remarks)
        self.trade_slips = Slips([w for w in self.trades if len(w) >= 5], 8, 5)
        self.fixed = {**dict.fromkeys((w for w in LEGAL if len(w) >= 6), "legal"), **dict.fromkeys((w for w in (*TITLES, *self.remarks) if len(w) >= 6), "title"), **dict.fromkeys((w for w in GENERATIONS if len(w) >= 6), "gen")}
        self.fixed_slips = Slips(self.fixed, 8, 5)
        self.forms = {fold_name(f): fold_name(n) for n, fs in given.items() for f in (n, *fs)}
        self.given_slips = Slips(self.forms, 7)
        self.cache: dict[str, tuple] = {}
        self.slips: dict[str, tuple[bool, bool, str] | None] = {}
        self.learned = {t for t in frequent if not self._begins(t) and self._classify(t)[0] in ("word", "short")}
        self.forms |= {t: t for t in self.learned}
        self.given_slips = Slips(self.forms, 7)
        self.cache.clear()

    def _begins(self, t: str) -> bool:
        return any(f.startswith(t) for f in self.forms)

    def _given_slip(self, w: str) -> tuple[bool, bool, str] | None:
        """The given name that a word is a slip of, after whether two slips apart and whether the first letter is one."""
        if w not in self.slips:
            if len(self.slips) > 200_000:
                self.slips.clear()
            self.slips[w] = min(((k > 1, onset, self.forms[f]) for k, onset, f in self.given_slips.near(w)), default=None)
        return self.slips[w]

    def _shorts(self, seen: list[tuple[str, str, str]]) -> list[str]:
        """Letters and short words that may shorten a given name."""
        return [t for t, k, _ in seen if len(t) <= 3 and k in ("short", "small", "part") and t not in ("von", "van", "der", "zu", "und") and self._begins(t)]

    def company(self, text: str) -> list[tuple[str, str]]:
        """(word, beside) of the words of a person's spelling that may be surnames or unlisted given names: beside each
        other where no given name or initial is told, beside nothing where one is or where the word stands alone. Listed
        given names stand beside None."""
        seen = self._seen(text)
        if any(k in ("legal", "trade") for _, k, _ in seen):
            return []
        listed = [(t, None) for t, k, _ in seen if k == "first"]
        loose = {t for t, k, _ in seen if k in ("word", "short") and len(t) >= 3 and not self._begins(t)}
        free = sorted(t for t in loose if not self._given_slip(t))
        told = len(free) < len(loose) or any(k == "first" for _, k, _ in seen) or any(t not in ("v", "d", "u") for t in self._shorts(seen))
        return listed + ([(t, "") for t in free] if told or len(free) < 2 else [(t, b) for t in free for b in free if b != t])

    def _class(self, t: str) -> tuple[str, str]:
        got = self.cache.get(t)
        if got is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            got = self.cache[t] = self._classify(t)
        return got

    def _short_trade(self, parts: tuple[str, ...]) -> str | None:
        """The trade that the parts shorten, one that they begin before others, then the shortest; or one whose
        beginning is a slip from them."""
        key = " ".join(parts) + " "
        if key not in self.slips:
            hit = [(not w.startswith(parts[0]), len(w), -n, w) for w, n in self.trades.items() if _shortens(list(parts), w)] if sum(map(len, parts)) >= 3 else []
            if not hit and len(parts) == 1 and len(parts[0]) >= 5:
                hit = [(len(w), -n, w) for w, n in self.trades.items() if any(near(parts[0], w[: len(parts[0]) + k], 1) for k in (-1, 0, 1))]
            self.slips[key] = min(hit)[-1] if hit else None
        return self.slips[key]

    def _classify(self, t: str) -> tuple[str, str]:
        if t in GENERATIONS:
            return "gen", GENERATIONS[t]
        if t in self.forms:
            return "first", self.forms[t]
        if t in LEGAL or t == "sche":
            return "legal", t
        if t in TITLES or t in self.remarks:
            return "title", t
        if t in _PARTICLES:
            return "small", t
        if t in self.trades:
            return "trade", t
        if len(t) >= 5:  # slips, the first letter included; the nearest word, of equally near ones that with the same first letter
            if hit := self.trade_slips.near(t):
                return "trade?", min(hit, key=lambda h: (h[0], h[1], -self.trades[h[2]]))[2]
            if hit := self.fixed_slips.near(t):
                w = hit[0][2]
                return (self.fixed[w], GENERATIONS.get(w, w))
        if is_trade(t):
            return "trade", t
        if len(t) <= 3:
            return "short", t
        return "word", t

    def _seen(self, text: str) -> list[tuple[str, str, str]]:
        """(token, class, value) of a spelling; tokens that together shorten a trade, and single letters that together
        write a legal form, are one."""
        folded = fold_name(text)
        met = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(folded)]
        out, k = [], 0
        while k < len(met):
            t, _, end = met[k]
            dotted = folded[end : end + 1] == "."
            run = k + 1  # tokens joined to this one by dots and hyphens without a space
            while run < len(met) and folded[met[run - 1][2] : met[run][1]] in (".-", "-"):
                run += 1
            if run - k > 1 and len(t) >= 2 and t not in LEGAL and (trade := self._short_trade(tuple(x for x, _, _ in met[k:run]))):
                out.append((t, "trade", trade))
                k = run
                continue
            kind, value = self._class(t)
            if dotted and len(t) >= 3 and kind in ("word", "short") and not self._begins(t) and (trade := self._short_trade((t,))):
                kind, value = "trade", trade
            if len(t) == 1 and kind in ("short", "small"):
                run = k
                while run < len(met) and len(met[run][0]) == 1:
                    run += 1
                joined = "".join(x for x, _, _ in met[k:run])
                rest = any(self._class(x)[0] == "word" for x, _, _ in met[run:])
                if joined in LETTERED and (any(c in ("trade", "legal") for _, c, _ in out) or any(self._class(x)[0] in ("trade", "trade?", "legal") for x, _, _ in met[run:]) or (out and not rest and "," not in folded)):
                    out.append((joined, "legal", joined))
                    k = run
                    continue
            if kind == "word" and len(t) <= 5 and folded[met[k][1] - 1 : met[k][1]] in ("'", "’", "`", "´"):
                kind = "small"  # an ending
            if kind == "word" and dotted:
                kind = "word."  # shortens something that is not known
            out.append((t, kind, value))
            k += 1
        if not any(k == "word" for _, k, _ in out):
            out = [(t, "word" if k == "word." else k, v) for t, k, v in out]
        person = any(k == "first" for _, k, _ in out) and not any(k in ("trade", "legal") for _, k, _ in out)
        # beside a given name, what is like a trade is a surname
        return [(t, "word" if person else "trade", t if person else v) if k == "trade?" else (t, k, v) for t, k, v in out]

    def read(self, text: str | None) -> tuple | None:
        if text is None:
            return None
        seen = self._seen(text)
        if not seen:
            return None
        gen = next((v for _, k, v in seen if k == "gen"), "")
        trade = next((v for _, k, v in seen if k == "trade"), "")
        words = [t for t, k, _ in seen if k == "word"]
        organised = trade or any(k == "legal" and t != "gen" for t, k, _ in seen)
        plain = lambda ws: " ".join(sorted({plain_sound(w[:-4] if w.endswith("sche") and len(w) > 9 else w) for w in ws}))
        if organised:
            own = words or [t for t, k, _ in seen if k == "short" and len(t) >= 2] or [t for t, k, _ in seen if k == "first"]
            if own and trade:
                return "F", plain(own), "", "", "", trade
            if own:
                return "W", plain(own), "", "", "", ""
        firsts = [v for _, k, v in seen if k == "first"]
        first, pre = (firsts[0] if firsts else ""), ""
        if not words and (learned := [t for t, k, _ in seen if k == "first" and t in self.learned]):  # somebody's surname after all
            words = [max(learned, key=len)]
            first = next((v for t, k, v in seen if k == "first" and t != words[0]), "")
        told = [(t, v) for t, k, v in seen if k == "first"]
        if not words and len(told) >= 2:  # the surname, too, is a given name: before a comma, else the last
            at = 0 if "," in text.strip(" ,") else -1
            words = [told[at][0]]
            first = told[at + 1 if at == 0 else 0][1]
        if not first and len(words) >= 2:  # a slip in the given name
            hit = min(((s, k) for k, w in enumerate(words) if (s := self._given_slip(w))), default=None)
            if hit:
                first = hit[0][2]
                words = [x for x in words if x != words[hit[1]]]
        if not first:
            shorts = self._shorts(seen)
            if gen:  # "d." is part of how the generation is written
                shorts = [t for t in shorts if t != "d"]
            pre = next((t for t in shorts if t not in ("v", "d", "u")), shorts[0] if shorts else "")
            if not pre and len(words) >= 2:
                pre = next((w for w in words if len(w) <= 4 and self._begins(w)), "")
                words = [w for w in words if w != pre]
        short = [t for t, k, _ in seen if k == "short" and len(t) >= 2 and t != pre]
        if not words and (first or pre) and short:  # a short surname
            words = [max(short, key=len)]
        if words and (first or pre):
            return "P", plain_sound(max(words, key=len)), first, pre, gen, ""
        whole = words + short
        if len(set(whole)) >= 2 or any(len(w) >= 2 and _UNSPACED.search(w) for w in whole):
            return "W", plain(whole), "", "", gen, ""
        return ("P", plain_sound(words[0]), "", "", gen, "") if words else None


def is_trade(t: str) -> bool:
    """Whether a word is built like one for a trade."""
    return any(len(t) > len(h) + 2 and t.endswith(h) for h in TRADE_HEADS)


def column_roles(texts: DataFrame, shelf: Shelf, company: int = 10) -> Roles:
    """Trades and remarks of a column, from where its words stand.

    A word that stands beside at least ``company`` different words, most of which
    keep less company than itself, names nobody alone.  If a fifth of its
    spellings hold a legal form it is a trade (legal forms themselves and words
    written with a dot are not); so is every word built like one, unless it is a
    slip of a trade thrice as usual.  If it never stands alone beside one other
    word it is a remark, unless it is a slip of a trade, title, legal form or given
    name: however large the table, a slip is read as the word it stands for.  Trades and remarks are few words however many names
    there are; beyond MOST_ROLES an error tells so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                folded = fold_name(text)
                met = [(m.group(), folded[m.end() : m.end() + 1] == ".") for m in _TOKEN.finditer(folded)]
                legal = any(t in LEGAL for t, _ in met)
                long = {t for t, _ in met if len(t) >= 2}
                alone = len(met) == 2
                for t, dotted in {t: d for t, d in met if len(t) >= 4 or len(t) == 3 and not d}.items():
                    others = [x for x in long if x != t and len(x) >= 4]
                    rows += [(t, x, legal, dotted, alone, n == 0) for n, x in enumerate(others or [""])]
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), *[pa.bool_()] * 4))], names=["w", "beside", "legal", "dotted", "alone", "once"])

    count = lambda c: F.sum((F.col("once") & c).cast("long"))
    met = texts.select("text").mapInArrow(run, "w string, beside string, legal boolean, dotted boolean, alone boolean, once boolean")
    met = met.groupBy("w", "beside").agg(count(F.lit(True)).alias("n"), count(F.col("legal")).alias("legal"), count(F.col("dotted")).alias("dotted"), count(F.col("alone")).alias("alone"))
    met = shelf.put(met, "beside")
    size = met.groupBy("w").agg(F.count_if(F.col("beside") != "").alias("company"), *[F.sum(c).alias(c) for c in ("n", "legal", "dotted", "alone")])
    size = shelf.put(size, "sizes")
    likely = size.filter(F.col("company") >= company).select("w", F.col("company").alias("mine"))
    less = met.select("w", "beside").join(likely, "w").join(size.select(F.col("w").alias("beside"), F.col("company").alias("theirs")), "beside").groupBy("w").agg(F.avg((F.col("theirs") < F.col("mine")).cast("double")).alias("less"))
    built = size.filter(F.regexp_like("w", F.lit("(" + "|".join(TRADE_HEADS) + ")$")) & (F.length("w") >= 7)).select("w", "n", F.lit(True).alias("trade"))
    usual = size.join(less.filter(F.col("less") >= 0.5), "w").filter(F.col("dotted") * 2 < F.col("n"))
    usual = usual.filter((F.col("legal") * 5 >= F.col("n")) | (F.col("alone") * 50 < F.col("n"))).select("w", "n", ((F.col("legal") * 5 >= F.col("n")) & (F.col("alone") * 50 >= F.col("n"))).alias("trade"))
    found = usual.unionByName(built).groupBy("w").agg(F.max("n").alias("n"), F.max("trade").alias("trade")).limit(MOST_ROLES + 1).collect()
    if len(found) > MOST_ROLES:
        raise ValueError(f"more than {MOST_ROLES} words with a role")
    given = {fold_name(f) for n, fs in GIVEN_NAMES.items() for f in (n, *fs)}
    known = LEGAL | TITLES | GENERATIONS.keys() | {"sche", *_PARTICLES} | given
    forms = Slips([w for w in LEGAL if len(w) >= 6], 8, 5)
    trades: dict[str, int] = {}
    near_trades = Slips((), 8, 5)
    for r in sorted(found, key=lambda r: (-r["n"], r["w"])):
        if r["trade"] and r["w"] not in known and not forms.near(r["w"]) and not any(trades[w] >= 3 * r["n"] for _, _, w in near_trades.near(r["w"])):
            trades[r["w"]] = r["n"]
            near_trades.add(r["w"])
    reader = NameReader(roles=Roles(tuple(trades.items())))
    plain = lambda w: len(w) < 4 or reader._classify(w)[0] == "word" and not reader._given_slip(w)
    return Roles(tuple(trades.items()), tuple(sorted(r["w"] for r in found if not r["trade"] and r["w"] not in known and plain(r["w"]))))


_SPELLING = "id long, kind string, own string, first string, pre string, gen string, trade string"


def unlisted_given(texts: DataFrame, surnames: int = 10, shelf: Shelf | None = None, roles: Roles = Roles()) -> list[str]:
    """Given names that the list lacks, by the company they keep: words that mostly stand beside another word where a
    given name is still open, beside at least ``surnames`` different ones with less company than themselves.  Slips of
    the word's usual companion are no company, so one bearer with very many rows makes no given name. Nor does a slip of
    a listed given name, though in a large table it stands beside many surnames: it is rarer by ``SLIP_TIMES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = NameReader(roles=roles)
        for b in batches:
            out = [x for t in b.column(0).to_pylist() for x in reader.company(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], names=["w", "beside"])

    met = texts.select("text").mapInArrow(run, "w string, beside string").groupBy("w", "beside").agg(F.count(F.lit(1)).alias("n"))
    met = (shelf or Shelf(texts.sparkSession, "company")).put(met, "company")  # read several times below
    by = lambda c: F.col("beside") != "" if c else F.col("beside") == ""
    words = met.groupBy("w").agg(F.sum(F.when(by(True), F.col("n")).otherwise(0)).alias("open"), F.sum(F.when(by(False), F.col("n")).otherwise(0)).alias("told"), F.max(F.when(by(True), F.struct("n", "beside"))).getField("beside").alias("usual"))
    words = words.filter(F.col("open") > 0)
    own = met.filter(by(True)).join(words, "w").filter((F.col("beside") == F.col("usual")) | (F.levenshtein("beside", "usual") > 3)).select("w", "beside", "open", "told")
    size = own.groupBy("w").agg(F.count(F.lit(1)).alias("company"), F.max("open").alias("open"), F.max("told").alias("told"))
    likely = size.filter((F.col("company") >= surnames) & (F.col("open") > F.col("told"))).select("w", "company")
    less = own.join(likely, "w").join(size.select(F.col("w").alias("beside"), F.col("company").alias("theirs")), "beside").filter(F.col("theirs") < F.col("company"))
    found = less.groupBy("w").agg(F.count(F.lit(1)).alias("count"), F.max(F.col("open") + F.col("told")).alias("n")).filter(F.col("count") >= surnames).collect()
    listed = {r["w"]: r["n"] for r in met.filter(F.col("beside").isNull()).select("w", "n").collect()} if found else {}  # forms of the list
    slips = Slips(listed, 4)
    return sorted(r["w"] for r in found if not any(listed[f] >= SLIP_TIMES * r["n"] for _, _, f in slips.near(r["w"])))


def spellings(names: DataFrame, id_col: str, columns: tuple[str, ...], order_col: str | None = None, shelf: Shelf | None = None) -> tuple[DataFrame, tuple[str, ...]]:
    """Every readable spelling of every id (of repeated ids the latest row), in parts; and the unlisted given names."""
    order = F.col(order_col) if order_col and order_col in names.columns else F.lit(0)
    one = names.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.struct(order.alias("o"), *[F.col(c).cast("string").alias(c) for c in columns]).alias("m"))
    one = one.groupBy("id").agg(F.max("m").alias("m"))
    each = one.select("id", F.explode(F.array_distinct(F.array(*[F.col(f"m.{c}") for c in columns]))).alias("text"))
    shelf = shelf or Shelf(names.sparkSession, "spellings")
    each = shelf.put(each.filter(F.length(F.trim("text")) > 0), "texts")
    roles = column_roles(each, shelf)
    frequent = tuple(unlisted_given(each, shelf=shelf, roles=roles))
    parts = [p.split()[0] for p in _SPELLING.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = NameReader(frequent=frequent, roles=roles)
        for b in batches:
            out = [(i, *r) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (r := reader.read(t))]
            cols = list(zip(*out)) or [[] for _ in parts]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.string()) for k, c in enumerate(cols)], names=parts)

    return each.mapInArrow(run, _SPELLING).distinct(), frequent


def _star(keyed: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Edges (a, b) from every cluster to the least cluster with the same key, instead of all pairs; a key may hold a third of them."""
    one = keyed.select("c", F.concat_ws("\u0001", *keys).alias("key"))
    if total <= SMALL_ROWS:  # one shuffle
        return one.select(F.col("c").alias("a"), F.min("c").over(Window.partitionBy("key")).alias("b")).filter(F.col("a") != F.col("b"))
    least = one.groupBy("key").agg(F.min("c").alias("b"), F.max("c").alias("top")).filter(F.col("b") < F.col("top")).select(F.col("key").alias("lk"), "b")
    return skew_lookup(one, "key", least, "lk", total).filter(F.col("c") != F.col("b")).select(F.col("c").alias("a"), "b")


def _beginnings(spark, unlisted: tuple[str, ...] = (), shelf: Shelf | None = None) -> DataFrame:
    """(known, pre): every way to shorten a given name or its pet forms; a few hundred rows from the fixed list, and
    five for each unlisted given name, written once."""
    rows = {(fold_name(n), fold_name(f)[:k]) for n, forms in GIVEN_NAMES.items() for f in (n, *forms) for k in range(1, 6)}
    rows |= {(n, n[:k]) for n in unlisted for k in range(1, 6)}
    table = spark.createDataFrame(sorted(rows), "known string, pre string")
    return shelf.put(table, "beginnings") if shelf else table


def _full_keys(profiles: DataFrame, beginnings: DataFrame) -> DataFrame:
    """(c, own, tag): what identifies a bearer: surname with given name and generation, own name with trade, or all words."""
    person = profiles.filter((F.col("kind") == "P") & (F.col("first") != "")).select("c", "own", F.concat_ws("|", F.lit("P"), "first", "gen").alias("tag"))
    firm = profiles.filter(F.col("kind") == "F").select("c", "own", F.concat_ws("|", F.lit("F"), "trade").alias("tag"))
    whole = profiles.filter(F.col("kind") == "W").select("c", "own", F.concat_ws("|", F.lit("W"), "gen").alias("tag"))
    # an initial of a merged profile stands for the one given name of the profile that it fits
    firsts = profiles.filter((F.col("kind") == "P") & (F.col("first") != "")).select("c", F.col("first").alias("known")).distinct()
    initials = profiles.filter((F.col("kind") == "P") & (F.col("first") == "") & (F.col("pre") != "")).select("c", "own", "pre", "gen").distinct()
    fits = initials.join(firsts, "c").join(F.broadcast(beginnings), ["known", "pre"])
    told = fits.groupBy("c", "own", "pre", "gen").agg(F.min("known").alias("lo"), F.max("known").alias("hi")).filter(F.col("lo") == F.col("hi"))
    told = told.select("c", "own", F.concat_ws("|", F.lit("P"), "lo", "gen").alias("tag"))
    return person.unionByName(firm).unionByName(whole).unionByName(told).distinct()


def _initial_edges(profiles: DataFrame, full: DataFrame, beginnings: DataFrame, total: int = 0, shelf: Shelf | None = None) -> DataFrame:
    """Profiles known by an initial only, to the one bearer of that surname, generation and initial; if nobody
    with a full given name bears the surname, to each other; if several fit, to none."""
    waiting = profiles.filter((F.col("kind") == "P") & (F.col("first") == "") & (F.col("pre") != "")).select("c", "own", "pre", "gen").distinct()
    kinds = waiting.select("own", "pre", "gen").distinct()
    named = full.filter(F.col("tag").startswith("P|")).select("own", F.split("tag", r"\|")[1].alias("known"), F.split("tag", r"\|")[2].alias("gen"), "c")
    bearers = named.groupBy("own", "known", "gen").agg(F.min("c").alias("b"), F.max("c").alias("top"))
    fits = kinds.join(bearers, ["own", "gen"]).join(F.broadcast(beginnings), ["known", "pre"])
    one = fits.groupBy("own", "pre", "gen").agg(F.min("b").alias("b"), F.max("top").alias("top"), F.count(F.lit(1)).alias("n"))
    key = F.concat_ws("\u0001", "own", "pre", "gen")
    placed = skew_lookup(waiting.select("c", key.alias("key")), "key", one.select(key.alias("ck"), "b", "top", "n"), "ck", total, "left")
    if shelf:  # read twice below
        placed = shelf.put(placed, "placed")
    known = placed.filter((F.col("n") == 1) & (F.col("b") == F.col("top")) & (F.col("c") != F.col("b"))).select(F.col("c").alias("a"), "b")
    return known.unionByName(_star(placed.filter(F.col("n").isNull()), ["key"], total))


def _one_turn(x: str, y: str):
    """Whether the words differ by two letters turned round and one other slip: all but two or three neighbouring places
    agree from the front and, counted from the back, one further letter is lost, added or another."""
    same = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.least(F.length(a), F.length(b))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(acc))
    front, back = same(F.col(x), F.col(y)), same(F.reverse(x), F.reverse(y))
    return front + back >= F.greatest(F.length(x), F.length(y)) - 4


def _slip_edges(full: DataFrame, rare: int, changed: DataFrame | None = None, shelf: Shelf | None = None) -> DataFrame:
    """Bearers whose surname or own name is a rare slip of another's, with the same given name or trade.

    Slips are profiles a third as large as the other or smaller, in that
    spelling and as a whole, however large both are; beside them small profiles
    (``rare``), unless the name is under five letters.  Only the usual spellings
    of a profile are what others slip from.  Blocking by the sorted letters and all ways to leave one out: any turned
    letters and one other slip still meet.  Of several neighbours the nearest,
    then the most frequent is taken; equally good neighbours leave it alone.
    Of ``changed`` clusters, if given, one must be among the spellings that meet.
    """
    forms = full.groupBy("own", "tag").agg(F.min("c").alias("c"), F.sum("rows").alias("n"), F.max("whole").alias("whole"), F.max("top").alias("top"))
    letters = F.array_join(F.array_sort(F.split("own", "")), "")
    forms = forms.filter(F.length("own") >= 2)
    if shelf:  # read several times below
        forms = shelf.put(forms, "forms")
    forms = forms.withColumn("letters", letters)
    less = F.transform(F.sequence(F.lit(1), F.length("letters")), lambda i: F.concat(F.substring(F.col("letters"), F.lit(1), i - 1), F.substring(F.col("letters"), i + 1, F.length("letters"))))
    # Spark takes the exploded keys to be as small as the forms: without the hints it would broadcast them
    keyed = forms.withColumn("k", F.explode(F.array_distinct(F.concat(F.array("letters"), less))))
    if changed is not None:
        keyed = keyed.join(keyed.join(changed, "c", "left_semi").select("tag", "k").distinct().hint("merge"), ["tag", "k"], "left_semi")
        if shelf:
            keyed = shelf.put(keyed, "keyed")
    a = keyed.select("tag", "k", F.col("own").alias("x"), F.col("n").alias("nx"), F.col("c").alias("cx"), F.col("whole").alias("wx"))
    b = keyed.filter(F.col("n") * 3 >= F.col("top")).select("tag", "k", F.col("own").alias("y"), F.col("n").alias("ny"), F.col("c").alias("cy"), F.col("whole").alias("wy"))
    small = (F.col("nx") <= rare) & (F.col("wx") <= 2 * rare) & (F.least(F.length("x"), F.length("y")) >= 5)
    rarer = (F.col("nx") * 3 <= F.col("ny")) & (F.col("wx") * 3 <= F.col("wy"))
    met = a.join(b.hint("merge"), ["tag", "k"]).filter((F.col("x") != F.col("y")) & (F.col("cx") != F.col("cy")) & ((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") > F.col("y")))) & (small | rarer))
    met = met.drop("k", "tag").distinct()
    lev = F.levenshtein("x", "y")
    turned = F.array_join(F.array_sort(F.split("x", "")), "") == F.array_join(F.array_sort(F.split("y", "")), "")
    onset = F.substring("x", 1, 1) == F.substring("y", 1, 1)
    single = ~F.col("x").contains(" ") & ~F.col("y").contains(" ")  # of several words, letters turned round between them are other words
    slips = F.when((lev == 1) & onset, 1).when(lev == 1, 2).when(turned & (lev == 2), 1).when(single & turned & (lev <= 4) & onset & (F.length("x") >= 8), 2).when(single & (lev <= 3) & onset & (F.length("x") >= 9) & (F.col("ny") >= 3) & _one_turn("x", "y"), 2)
    met = met.withColumn("slips", slips).filter(F.col("slips").isNotNull())
    at = lambda c: F.min(F.struct("slips", F.negative("ny").alias("m"), c.alias("c"))).getField("c")
    best = met.groupBy("cx", "x").agg(at(F.col("cy")).alias("lo"), F.bitwise_not(at(F.bitwise_not("cy"))).alias("hi"))  # of the best neighbours the least and the greatest
    return best.filter(F.col("lo") == F.col("hi")).select(F.col("cx").alias("a"), F.col("lo").alias("b"))


def link_variants(names: DataFrame, id_col: str = "name_id", columns: tuple[str, ...] = ("current_name", "alternative_name"), order_col: str | None = "loaded_at", rare: int = 2, max_rounds: int = 200) -> DataFrame:
    """(id, bearer): every id with the least id of its bearer.

    Null ids are ignored; of a repeated id the latest row counts; rows without
    any readable name are bearers of their own; very long names are read whole;
    other columns are ignored; an empty table gives an empty result.  Rounds go on until nothing merges; ``max_rounds``
    only guards against an endless loop.
    """
    spark = names.sparkSession
    ship(spark)
    shelf = Shelf(spark, "variants")
    read, unlisted = spellings(names, id_col, columns, order_col, shelf)
    read, beginnings = shelf.put(read, "spellings"), _beginnings(spark, unlisted, shelf)
    ids = names.select(F.col(id_col).cast("long").alias("id")).filter(F.col("id").isNotNull()).distinct()
    label = shelf.put(ids.select("id", F.col("id").alias("c")), "labels")
    changed, total, spelt = None, None, rows_of(label)
    for _ in range(max_rounds):
        per = read.join(label, "id")
        profiles = shelf.put(per.groupBy("c", "kind", "own", "first", "pre", "gen", "trade").agg(F.count(F.lit(1)).alias("rows")), "profiles")
        if changed is not None:  # names that a merged profile bears; all others stand as they did
            owns = profiles.join(changed, "c", "left_semi").select("own").distinct()
            near_by = shelf.put(profiles.join(owns, "own", "left_semi").select("c").distinct(), "near")
            around = shelf.put(profiles.join(near_by, "c", "left_semi"), "around")
        else:
            around = profiles
        full = shelf.put(_full_keys(profiles, beginnings), "keys")
        some = full if changed is None else full.join(near_by, "c", "left_semi")
        sized = profiles.groupBy("c", "own").agg(F.sum("rows").alias("rows"))
        sized = sized.withColumns({"whole": F.sum("rows").over(Window.partitionBy("c")), "top": F.max("rows").over(Window.partitionBy("c"))})  # the spellings of one profile
        slips = shelf.put(_slip_edges(full.join(sized, ["c", "own"]), rare, changed, shelf), "slips")
        total = total or 2 * rows_of(profiles)  # later rounds have no more
        edges = _star(some, ["own", "tag"], total).unionByName(_initial_edges(around, some, beginnings, total, shelf)).unionByName(slips)
        edges = shelf.put(edges, "edges")
        links = rows_of(edges)
        if not links:
            break
        groups = components_in_one_task(edges, "a", "b") if links <= ONE_TASK_EDGES else connected_components(edges, "a", "b", None, shelf)
        merged = shelf.put(groups.select(F.col("id").alias("k"), F.col("group_id").alias("to")), "merged")
        nxt = shelf.put(skew_lookup(label, "c", merged, "k", spelt, "left").select("id", F.coalesce("to", "c").alias("c")), "labels")
        shelf.drop(label)
        label, changed = nxt, merged.select(F.col("to").alias("c"))
    else:
        raise RuntimeError("merging did not end")
    return label.select("id", F.col("c").alias("bearer"))


def variant_pairs(linked: DataFrame, id_col: str = "name_id") -> DataFrame:
    """(id_1, id_2) with id_1 < id_2 of every two ids of one bearer; a bearer of many ids is dealt over tasks in blocks."""
    return linked_pairs(linked.select(F.col("bearer").alias("group_id"), "id"), f"{id_col}_1", f"{id_col}_2")
