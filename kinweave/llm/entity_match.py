"""Matching entities of two sources that share no identifier.

Sorted neighbourhood: the records of both sources are sorted by several
composite keys; records near each other in any order are compared field by field; each comparison adds or takes evidence, and the sum is the confidence.
Records of one source that mean the same entity are first made one, then
entities of the two sources are assigned to each other one to one so that the
total confidence is greatest.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinweave.functions.text import nfc
from kinweave.operators.components import connected_components
from kinweave.runtime import Shelf, rows_of, ship

#: Legal forms, folded to lower case without umlauts, as they are written out or shortened. Fixed values.
LEGAL_FORMS = (
    r"gesellschaft mit beschrankter haftung|mit beschrankter haftung|ges\.? ?m\.? ?b\.? ?h\.?|g\.? ?m\.? ?b\.? ?h\.?|kommanditgesellschaft auf aktien|komm\.?-?ges\.? a\.? ?akt\.?|k\.?-?g\.? ?a\.? ?a\.?|kgaa|"
    r"kommanditgesellschaft|aktiengesellschaft|actien-?gesellschaft|akt\.?-?ges\.?|act\.?-?ges\.?|a\.?-? ?g\.?|eingetragene genossenschaft|eingetr\.? gen\.?|e\.? ?gen\.?|e\.? ?g\.?|in liquidation|i\. ?liqu\.?|gebruder|vormals|vorm\.?"
)


def fold(c: Column) -> Column:
    """Lower case, umlauts and long s to plain letters, digits misread for letters back."""
    c = F.translate(F.lower(nfc(c)), "äöüſéèêáàâôîûç", "aouseeeaaaoiuc")
    return F.regexp_replace(c, "ß", "ss")


def parse_date(c: Column) -> Column:
    """A date as yyyymmdd: 1882-10-26, 11./10. 1876 or 2.2.73 (of the years 1850 to 1949); else null."""
    num = lambda m, g: F.try_to_number(F.regexp_extract(c, m, g), F.lit("9999")).cast("int")
    iso, long, short = r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})\s*$", r"^\s*(\d{1,2})\.\s*/\s*(\d{1,2})\.\s*(\d{4})\s*$", r"^\s*(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{2})\s*$"
    full = r"^\s*(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})\s*$"
    yy = num(short, 3)
    return (
        F.when(c.rlike(iso), num(iso, 1) * 10000 + num(iso, 2) * 100 + num(iso, 3))
        .when(c.rlike(long), num(long, 3) * 10000 + num(long, 2) * 100 + num(long, 1))
        .when(c.rlike(full), num(full, 3) * 10000 + num(full, 2) * 100 + num(full, 1))
        .when(c.rlike(short), (F.when(yy < 50, yy + 1900).otherwise(yy + 1800)) * 10000 + num(short, 2) * 100 + num(short, 1))
    )


def _days(ymd: Column) -> Column:
    """Days since 1970 of a yyyymmdd number; null where the calendar has no such day."""
    text = F.format_string("%04d-%02d-%02d", F.floor(ymd / 10000).cast("int"), F.floor(ymd / 100).cast("int") % 100, ymd % 100)
    return F.when(ymd.isNotNull(), F.unix_date(text.try_cast("date")))


def _degrees(c: Column, limit: float) -> Column:
    """A usable coordinate: a longitude a turn too far is turned back, a latitude ten times too great
    has lost its decimal point; null, NaN, 0 and what is impossible even so are none."""
    v = F.when(c.isNotNull() & ~F.isnan(c) & (c != 0), c)
    mended = v / 10 if limit == 90.0 else v - F.signum(v) * 360.0
    return F.when(F.abs(v) <= limit, v).when(F.abs(mended) <= limit, mended)


def _tokens(name: Column) -> Column:
    plain = F.regexp_replace(F.translate(fold(name), "01", "ol"), rf"(?<![\p{{L}}])(?:{LEGAL_FORMS})(?![\p{{L}}])", " ")
    return F.filter(F.regexp_extract_all(plain, F.lit(r"[\p{L}]+"), F.lit(0)), lambda t: F.length(t) >= 2)


def _grams(tokens: Column) -> Column:
    three = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.hash(F.substr(F.concat(F.lit("_"), t, F.lit("_")), i.cast("int"), F.lit(3))))
    return F.array_distinct(F.flatten(F.transform(tokens, three)))


def records(df: DataFrame, source: int, id_col: str, name: str, lat: str, lon: str, order_col: str = "loaded_at") -> DataFrame:
    """One row per non-null id (the latest), with the fields the comparison uses."""
    known = set(df.columns)
    text = lambda c: F.col(c).cast("string") if c in known else F.lit(None).cast("string")
    order = F.col(order_col) if order_col in known else F.lit(0)
    cols = F.struct(
        order.alias("o"), text(name).alias("name"), text("city").alias("city"), text("industry").alias("industry"), text("purpose").alias("purpose"),
        text("capital_text").alias("capital"), text("found_date_modified").alias("found"), text("found_year").alias("year"), text("register_date_modified").alias("registered"),
        F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"),
    )
    one = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), cols.alias("m")).groupBy("id").agg(F.max("m").alias("m")).select("id", "m.*")
    year = F.expr("try_cast(regexp_extract(year, '(\\\\d{4})', 1) as int)")
    found = parse_date(F.col("found"))
    trade = F.regexp_replace(F.trim(fold(F.col("industry"))), r"[.\s]+$", "")
    capital = F.regexp_replace(F.regexp_replace(F.regexp_extract(F.translate(F.col("capital"), "Oo", "00"), r"^[^\d]*([\d .]*\d)", 1), r"[^\d]", ""), r"^0+", "")
    city = F.regexp_replace(fold(F.col("city")), r"[^\p{L}.]", "")
    return one.select(
        F.lit(source).alias("src"), "id", F.coalesce(_tokens(F.col("name")), F.array().cast("array<string>")).alias("tokens"),
        F.when(F.length(F.regexp_replace(city, r"\.", "")) > 0, city).alias("city"),
        F.when(F.length(trade) > 0, trade).alias("trade"),
        F.when(F.length(F.trim("purpose")) > 0, F.xxhash64(fold(F.trim("purpose")))).alias("purpose"),
        F.when(F.length(capital).between(1, 18), capital.cast("long")).alias("capital"),
        found.alias("found"), F.coalesce(F.floor(found / 10000).cast("int"), year).alias("year"), parse_date(F.col("registered")).alias("registered"), _days(found).alias("found_n"), _days(parse_date(F.col("registered"))).alias("registered_n"),
        _degrees(F.col("lat"), 90.0).alias("lat"), _degrees(F.col("lon"), 180.0).alias("lon"),
    )


def with_core(rows: DataFrame, common_above: float = 0.002) -> DataFrame:
    """Adds the name's own words (those that at most ``common_above`` of all records hold; short ones
    only where there is no word of four letters), their three-letter grams, and the first letters of
    its common words, which tell the trade.

    A record holds a few words, so at most (words a record) / common_above
    different words are that common; this short list is collected and applied
    to every row in place.
    """
    n = rows.count()
    df = rows.select(F.explode(F.array_distinct("tokens")).alias("t")).groupBy("t").count().filter(F.col("count") > F.lit(max(2.0, common_above * n)))
    common = F.array(*[F.lit(r[0]) for r in df.select("t").collect()]).cast("array<string>")
    first = lambda x: F.substring(x, 1, 4)
    long = lambda c: F.filter(c, lambda t: F.length(t) >= 4)
    kind = F.array_remove(F.array_distinct(F.transform(long(F.array_intersect("tokens", common)), first)), F.coalesce(first(F.col("city")), F.lit("-")))
    own = F.array_distinct(F.array_except("tokens", common))
    core = F.when(F.size(long(own)) > 0, long(own)).otherwise(own)
    return rows.withColumn("core", core).withColumn("kind", kind).withColumn("grams", _grams(F.col("core"))).drop("tokens")


def without_empty_trades(rows: DataFrame, least: int = 5, agreed: float = 0.3) -> DataFrame:
    """Trades that tell nothing become null.

    Records with one founding date, capital and place are as good as certainly
    one firm.  A label that meets another record there at least ``least`` times
    and in under ``agreed`` of these has the same label beside it is a remark of
    the register and no trade.  There are fewer such labels than 1 / ``least`` of
    the labels met; they are looked up by a join, broadcast if Spark finds them small.
    """
    known = rows.filter(F.col("found").isNotNull() & F.col("capital").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("trade").isNotNull())
    key = ["found", "capital", F.round("lat", 2).alias("at"), F.round("lon", 2).alias("on")]
    per = known.groupBy(*key, "trade").agg(F.count(F.lit(1)).alias("n"))
    sizes = per.groupBy("found", "capital", "at", "on").agg(F.sum("n").alias("all"))
    met = per.join(sizes, ["found", "capital", "at", "on"]).filter(F.col("all") > 1)
    told = met.groupBy("trade").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("same"))
    empty = told.filter((F.col("rows") >= least) & (F.col("same") < agreed * F.col("rows"))).select(F.col("trade").alias("no_trade"))
    return rows.join(empty, rows["trade"] == empty["no_trade"], "left").withColumn("trade", F.when(F.col("no_trade").isNull(), F.col("trade"))).drop("no_trade")


def _key_rows(rows: DataFrame) -> DataFrame:
    """Each record under its composite sort keys; a key with no content is left out."""
    s = lambda *c: F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("~")) for x in c])
    city, found, cap, reg, trade = F.substring("city", 1, 4), F.col("found"), F.col("capital"), F.col("registered"), F.col("trade")
    own = F.array_sort("core")
    first, last = F.get(own, F.lit(0)), F.get(F.reverse(own), F.lit(0))
    here = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    keys = F.array(
        F.when(found.isNotNull(), s(F.lit("1"), found, trade, first)),
        F.when(found.isNotNull() & here, s(F.lit("2"), found, F.round("lat", 1), cap)),
        F.when(first.isNotNull(), s(F.lit("3"), F.reverse(last), found, cap)),
        F.when(reg.isNotNull(), s(F.lit("4"), reg, F.col("year"), trade, first)),
        F.when(here, s(F.lit("5"), F.round("lat", 2), F.round("lon", 2), trade, F.col("lat"))),
        F.when(cap.isNotNull() & F.col("year").isNotNull(), s(F.lit("6"), trade, F.col("year"), cap, found)),
        F.when(F.col("year").isNotNull(), s(F.lit("7"), F.col("purpose"), city, F.col("year"), cap)),
    )
    words = F.flatten(F.transform(own, lambda t: F.array(F.concat_ws("|", F.lit("8"), t, F.coalesce(found.cast("string"), F.lit("~")), F.coalesce(cap.cast("string"), F.lit("~"))), F.concat_ws("|", F.lit("9"), t, F.coalesce(city, F.lit("~")), F.coalesce(trade, F.lit("~")), F.coalesce(cap.cast("string"), F.lit("~"))))))
    return rows.withColumn("key", F.explode(F.array_distinct(F.concat(F.array_compact(keys), words))))


def name_evidence(a, b) -> Column:
    shared = F.size(F.array_intersect(a["grams"], b["grams"])) / F.greatest(F.lit(1), F.least(F.size(a["grams"]), F.size(b["grams"])))
    known = (F.size(a["grams"]) > 0) & (F.size(b["grams"]) > 0)
    own = F.when(~known, 0.0).when(shared >= 0.75, 5.0).when(shared >= 0.5, 3.5).when(shared >= 0.3, 1.0).when(shared >= 0.15, -1.0).otherwise(-3.0)
    kind = F.when((F.size(a["kind"]) == 0) | (F.size(b["kind"]) == 0), 0.0).when(F.arrays_overlap(a["kind"], b["kind"]), 0.5).otherwise(-1.5)
    return own + kind


#: The most that name_evidence and city_evidence give.
_TEXT_MOST = 6.5


def _km(a, b) -> Column:
    dlat, dlon = F.abs(a["lat"] - b["lat"]), F.abs(a["lon"] - b["lon"])
    dlon = F.least(dlon, 360.0 - dlon) * F.cos(F.radians(a["lat"]))
    return 111.2 * F.sqrt(dlat * dlat + dlon * dlon)


def city_evidence(a, b) -> Column:
    prefix = lambda x, y: x.contains(".") & y.startswith(F.regexp_replace(x, r"\..*$", ""))
    close = F.coalesce(_km(a, b) <= 4.0, F.lit(False))
    other = F.when(close | prefix(a["city"], b["city"]) | prefix(b["city"], a["city"]), 0.5).when(F.levenshtein(a["city"], b["city"]) <= 3, -0.5).otherwise(-5.0)
    return F.when(a["city"].isNull() | b["city"].isNull(), 0.0).when(a["city"] == b["city"], 1.0).otherwise(other)


def _date_evidence(a, b, na, nb, same: float, slip: float, other: float):
    """Equal dates; dates a usual slip apart (one part of the date wrong, parts swapped, a day, ten days, a month or a year off); or others."""
    import numpy as np

    y, m, d = (lambda x: x // 10000), (lambda x: x // 100 % 100), (lambda x: x % 100)
    ya, ma, da, yb, mb, db = y(a), m(a), d(a), y(b), m(b), d(b)
    alike = (ya == yb).astype(np.int8) + (ma == mb) + (da == db)
    swapped = (ya == yb) & (ma == db) & (da == mb)
    off = np.abs(na - nb)
    usual = (off == 1) | (off == 10) | ((off >= 28) & (off <= 31)) | ((off >= 364) & (off <= 367))
    out = np.where(usual | ((np.abs(ya - yb) <= 1) & (swapped | (alike >= 2))), slip, other)
    return np.where((a == 0) | (b == 0), 0.0, np.where(a == b, same, out))


def field_evidence(a: dict, b: dict):
    """Evidence of every field but name and city, for (positive) and against (negative) one entity, over arrays of sketches."""
    import numpy as np

    dlon = np.abs(a["lon"] - b["lon"])
    dlon = np.minimum(dlon, 360.0 - dlon) * np.cos(np.radians(a["lat"]))
    km = 111.2 * np.sqrt((a["lat"] - b["lat"]) ** 2 + dlon**2)
    place = np.select([np.isnan(km), km <= 0.1, km <= 0.6, km <= 2.0, km <= 4.0, km <= 25.0], [0.0, 3.0, 2.0, 1.0, 0.0, -2.5], -4.0)
    found = _date_evidence(a["found"], b["found"], a["found_n"], b["found_n"], 5.0, 2.5, -5.0)
    no_year = ((a["found"] != 0) & (b["found"] != 0)) | (a["year"] == 0) | (b["year"] == 0)
    year = np.where(no_year, 0.0, np.where(np.abs(a["year"] - b["year"]) <= 1, 1.0, -2.5))
    registered = _date_evidence(a["registered"], b["registered"], a["registered_n"], b["registered_n"], 4.0, 1.5, -2.0)
    ca, cb = a["capital"], b["capital"]
    raised = np.abs(np.minimum(ca, cb) * 1.5 - np.maximum(ca, cb)) <= 25_000
    capital = np.where((ca == 0) | (cb == 0), 0.0, np.where(ca == cb, 3.0, np.where(raised, 1.5, -1.5)))
    same = lambda f, yes, no: np.where((a[f] == 0) | (b[f] == 0), 0.0, np.where(a[f] == b[f], yes, no))
    return place + found + year + registered + capital + same("trade", 1.0, -4.0) + same("purpose", 2.0, -1.0)


#: What the sorted table carries of a record: numbers and hashes only; 0 (NaN for coordinates) is null.
_SKETCH = ("src", "id", "found", "found_n", "year", "registered", "registered_n", "capital", "trade", "purpose", "lat", "lon")
_PAIR = ("s1", "id1", "s2", "id2", "rest")


def _slide(window: int, least: float):
    """Sorted sketches to (kind 0) neighbour pairs with enough evidence and (kind 1) the first and
    last rows of the partition, whose neighbours lie in the next one.

    Batches are compared as arrays shifted by 1..window places; the last rows of
    a batch go before the next one, so a task holds one batch.
    """

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        part, seen, tail, head = TaskContext.get().partitionId(), 0, None, None
        for b in batches:
            if not b.num_rows:
                continue
            new = {c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(_SKETCH)}
            new["at"] = np.arange(seen, seen + b.num_rows)
            if head is None or len(head["at"]) < window:
                more = {c: v[:window] for c, v in new.items()}
                head = more if head is None else {c: np.concatenate([head[c], more[c]])[:window] for c in head}
            rows = new if tail is None else {c: np.concatenate([tail[c], new[c]]) for c in new}
            old = 0 if tail is None else len(tail["at"])
            seen += b.num_rows
            for k in range(1, window + 1):
                lo = max(0, old - k)  # pairs within the old rows are done
                if len(rows["at"]) - k <= lo:
                    continue
                x, y = {c: v[lo : len(v) - k] for c, v in rows.items()}, {c: v[lo + k :] for c, v in rows.items()}
                keep = _hopeful(x, y, least)
                if keep is not None:
                    yield _out(0, keep, None)
            tail = {c: v[-window:] for c, v in rows.items()}
        if head is not None:
            ends = {c: np.concatenate([head[c], tail[c]]) for c in head}
            _, first = np.unique(ends["at"], return_index=True)
            ends = {c: v[first] for c, v in ends.items()}
            yield _out(1, None, ends | {"part": np.full(len(first), part), "rows": np.full(len(first), seen)})

    def _out(kind, pairs, ends):
        import numpy as np
        import pyarrow as pa

        n = len(pairs["s1"]) if pairs else len(ends["at"])
        cols, names = [pa.array(np.full(n, kind, np.int32))], ["kind"]
        for c in _PAIR:
            kind_of = pa.float64() if c == "rest" else pa.int64()
            cols.append(pa.array(pairs[c], kind_of) if pairs else pa.nulls(n, kind_of))
            names.append(c)
        for c in (*_SKETCH, "at", "part", "rows"):
            kind_of = pa.float64() if c in ("lat", "lon") else pa.int64()
            cols.append(pa.array(ends[c], kind_of, from_pandas=False) if ends else pa.nulls(n, kind_of))
            names.append(c)
        return pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _hopeful(x: dict, y: dict, least: float) -> dict | None:
    """Of neighbours x[i], y[i], those of different records whose field evidence reaches ``least``."""
    import numpy as np

    rest = field_evidence(x, y)
    ok = np.flatnonzero((rest >= least) & ((x["id"] != y["id"]) | (x["src"] != y["src"])))
    if not len(ok):
        return None
    turn = (x["src"][ok] > y["src"][ok]) | ((x["src"][ok] == y["src"][ok]) & (x["id"][ok] > y["id"][ok]))
    pick = lambda p, q, f: np.where(turn, q[f][ok], p[f][ok])
    return {"s1": pick(x, y, "src"), "id1": pick(x, y, "id"), "s2": pick(y, x, "src"), "id2": pick(y, x, "id"), "rest": rest[ok]}


def _compare(least: float):
    """(x.., y..) rows of two sketches each to pairs with enough evidence."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        n = len(_SKETCH)
        for b in batches:
            x, y = ({c: b.column(k + i).to_numpy(zero_copy_only=False) for i, c in enumerate(_SKETCH)} for k in (0, n))
            keep = _hopeful(x, y, least) if b.num_rows else None
            if keep is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(keep[c]), pa.float64() if c == "rest" else pa.int64()) for c in _PAIR], names=list(_PAIR))

    return run


def across_ends(ends: DataFrame, window: int, least: float) -> DataFrame:
    """Pairs across partition ends, from the first and last rows of every partition.

    A row's place in the whole order is the rows of all partitions before its own plus its place there (one small row
    a partition is summed); rows at most ``window`` places apart meet by an equi-join on the place.
    """
    sizes = ends.groupBy("part").agg(F.max("rows").alias("rows"))
    before = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))  # one row a partition
    placed = ends.join(before, "part").select((F.col("before") + F.col("at")).alias("place"), "part", *_SKETCH)
    x = placed.select(F.explode(F.array([F.col("place") + k for k in range(1, window + 1)])).alias("place"), F.col("part").alias("x_part"), *[F.col(c).alias(f"x_{c}") for c in _SKETCH])
    y = placed.select("place", F.col("part").alias("y_part"), *[F.col(c).alias(f"y_{c}") for c in _SKETCH])
    met = x.join(y, "place").filter(F.col("x_part") != F.col("y_part")).select(*[f"x_{c}" for c in _SKETCH], *[f"y_{c}" for c in _SKETCH])
    return met.mapInArrow(_compare(least), ", ".join(f"{c} {'double' if c == 'rest' else 'long'}" for c in _PAIR))


def scored_neighbours(rows: DataFrame, shelf: Shelf, window: int = 6, threshold: float = 6.0) -> DataFrame:
    """(s1, id1, s2, id2, score): neighbours in any sort order with at least ``threshold`` evidence, each once.

    The records' keys are range-partitioned and sorted with sketches of the
    records; neighbours whose numbers and dates leave the threshold within reach
    of name and city meet again with their texts, once each.  Neighbours on
    either side of a partition's end (2 x window rows a partition are kept) meet by their places.
    """
    spark = rows.sparkSession
    ship(spark)
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(10**9) if c.endswith("_n") else 0).cast("long")).alias(c)
    coded = lambda c: F.when(F.col(c).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(c)).alias(c)
    place = lambda c: F.coalesce(F.col(c), F.lit(float("nan"))).alias(c)
    sketch = [coded(c) if c in ("trade", "purpose") else place(c) if c in ("lat", "lon") else number(c) for c in _SKETCH]
    keyed = _key_rows(rows).select("key", "own_id", *sketch)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(n, "key", "src", "own_id").sortWithinPartitions("key", "src", "own_id").select(*_SKETCH)
    least = threshold - _TEXT_MOST
    kinds = ", ".join(f"{c} double" if c in ("rest", "lat", "lon") else f"{c} long" for c in (*_PAIR, *_SKETCH, "at", "part", "rows"))
    met = shelf.put(ordered.mapInArrow(_slide(window, least), f"kind int, {kinds}"), "met")
    pairs = met.filter(F.col("kind") == 0).select(*_PAIR).unionByName(across_ends(met.filter(F.col("kind") == 1), window, least))
    once = pairs.groupBy("s1", "id1", "s2", "id2").agg(F.max("rest").alias("rest"))
    texts = F.struct("grams", "kind", "city", "lat", "lon")
    full = once.join(rows.select(F.col("id").alias("id1"), texts.alias("a")), "id1").join(rows.select(F.col("id").alias("id2"), texts.alias("b")), "id2")
    score = F.col("rest") + city_evidence(F.col("a"), F.col("b")) + name_evidence(F.col("a"), F.col("b"))
    return full.select("s1", "id1", "s2", "id2", score.alias("score")).filter(F.col("score") >= threshold)


def best_assignment(edges: list[tuple[int, int, float]]) -> dict[int, int]:
    """One-to-one assignment {left: right} of the greatest total confidence; of equal ones any, but always the same.

    Lefts enter one by one; each takes the cheapest way of exchanges to a right
    that is free, or to leaving some left single (at worst itself), searched by
    Dijkstra over reduced costs.  Prices of rights keep these costs from becoming negative.
    """
    offers: dict[int, list[tuple[int, float]]] = {}
    top = max((c for _, _, c in edges), default=0.0)
    for a, b, c in sorted(edges):
        offers.setdefault(a, []).append((b, top - c))  # costs; staying single costs ``top``
    price: dict[int, float] = {}
    base: dict[int, float] = {}  # of an entered left: the least of what it pays or could pay
    owner: dict[int, int] = {}
    mine: dict[int, int] = {}
    for start in sorted(offers):
        came: dict[int, int] = {}  # right -> the left that reaches it
        dist: dict[int, float] = {}
        done: dict[int, float] = {}
        heap: list[tuple[float, int]] = []
        lefts: list[tuple[int, float]] = [(start, 0.0)]
        end, cost, single = None, float("inf"), start
        a, d = start, 0.0
        base[start] = min([top, *(w - price.get(b, 0.0) for b, w in offers[start])])
        while True:
            if d + top - base[a] < cost:  # this left goes single
                end, cost, single = None, d + top - base[a], a
            for b, w in offers[a]:
                if b in done or mine.get(a) == b:
                    continue
                v = d + w - price.get(b, 0.0) - base[a]
                if v < dist.get(b, float("inf")):
                    dist[b], came[b] = v, a
                    heapq.heappush(heap, (v, b))
            while heap and heap[0][1] in done:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= cost:
                break
            d, b = heapq.heappop(heap)
            done[b] = d
            if b not in owner:
                end, cost = b, d
                break
            a = owner[b]
            lefts.append((a, d))
        for x, far in lefts:
            base[x] += max(0.0, cost - far)
        for x, far in done.items():
            price[x] = price.get(x, 0.0) - max(0.0, cost - far)
        if end is None:
            b = mine.pop(single, None)
            if b is None:
                continue  # the new left itself stays single
            a = came[b]
        else:
            b, a = end, came[end]
        while True:
            owner[b], old = a, mine.get(a)
            mine[a] = b
            if a == start:
                break
            b = old
            a = came[b]
    return mine


def _assign_component(pdf):
    import pandas as pd

    edges = list(zip(pdf["e1"].tolist(), pdf["e2"].tolist(), pdf["score"].tolist()))
    mine = best_assignment(edges)
    best: dict[tuple[int, int], float] = {}
    for a, b, c in edges:
        best[(a, b)] = max(c, best.get((a, b), c))
    return pd.DataFrame({"e1": list(mine), "e2": list(mine.values()), "score": [best[x] for x in mine.items()]}).astype({"e1": "int64", "e2": "int64", "score": "float64"})


def bidding(edges: DataFrame, shelf: Shelf, eps: float = 0.05, rounds: int = 20) -> DataFrame:
    """(e1, e2, score): one-to-one, by an auction in which all free lefts bid at once, for components too large for a task.

    A bid raises the price of its right by at least ``eps``, so the total is
    within ``eps`` a record of the greatest.  After every ``rounds`` rounds the
    step is doubled for those who still bid: once it exceeds the greatest
    confidence, each right bid for is closed for good, so the rounds are at most
    rounds x (2 + log2(greatest / eps)) plus the most rights that one left has.
    """
    spark = edges.sparkSession
    state = shelf.put(spark.createDataFrame([], "e2 long, owner long, price double"), "prices")
    top = edges.agg(F.max("score")).first()[0] or 0.0
    n = 0
    while True:
        step = eps * 2.0 ** min(n // rounds, 60)
        offers = edges.join(state.select("e2", "price"), "e2", "left").withColumn("v", F.col("score") - F.coalesce("price", F.lit(0.0)))
        free = offers.join(state.select(F.col("owner").alias("e1")), "e1", "left_anti").filter(F.col("v") > 0)
        top_two = free.groupBy("e1").agg(F.max(F.struct("v", F.negative("e2").alias("r"))).alias("m"), F.sort_array(F.collect_list("v"), False).alias("vs"))  # the rights of one left
        bids = top_two.select((-F.col("m.r")).alias("e2"), F.col("e1").alias("owner"), F.col("m.v").alias("v"), F.coalesce(F.get("vs", F.lit(1)), F.lit(0.0)).alias("second"))
        bids = bids.join(state.select("e2", F.col("price").alias("was")), "e2", "left").select("e2", "owner", (F.coalesce("was", F.lit(0.0)) + F.col("v") - F.col("second") + step).alias("price"))
        bids = shelf.put(bids.groupBy("e2").agg(F.max(F.struct("price", F.negative("owner").alias("o"))).alias("m")).select("e2", (-F.col("m.o")).alias("owner"), F.col("m.price").alias("price")), "bids")
        if bids.isEmpty():
            return state.select(F.col("owner").alias("e1"), "e2").join(edges, ["e1", "e2"]).select("e1", "e2", "score")
        n += 1
        if n > rounds * (3 + math.log2(max(top, eps) / eps)) + 10_000:
            raise RuntimeError("bidding did not end")
        nxt = shelf.put(state.join(bids.select("e2"), "e2", "left_anti").unionByName(bids), "prices")
        shelf.drop(state)
        state = nxt


def assign(confidence: DataFrame, shelf: Shelf, task_edges: int = 200_000) -> DataFrame:
    """(e1, e2, score): one-to-one, of greatest total confidence.  Lefts and rights have different numbers.

    Pairs without a rival are taken as they are; contested ones are solved
    exactly, component by component, in tasks; components of more than
    ``task_edges`` pairs by ``bidding`` (within its step a record).
    """
    ship(confidence.sparkSession)
    once = shelf.put(confidence.groupBy("e1", "e2").agg(F.max("score").alias("score")), "pairs")
    groups = connected_components(once, "e1", "e2", None, shelf)
    placed = once.join(groups.select(F.col("id").alias("e1"), F.col("group_id").alias("g")), "e1")
    placed = shelf.put(placed, "placed")
    size = shelf.put(placed.groupBy("g").agg(F.count(F.lit(1)).alias("edges")), "sizes")
    sized = placed.join(size, "g")
    alone = sized.filter(F.col("edges") == 1).select("e1", "e2", "score")
    some = sized.filter((F.col("edges") > 1) & (F.col("edges") <= task_edges)).select("g", "e1", "e2", "score")
    out = alone.unionByName(some.groupBy("g").applyInPandas(_assign_component, "e1 long, e2 long, score double"))
    if not size.filter(F.col("edges") > task_edges).isEmpty():
        out = out.unionByName(bidding(shelf.put(sized.filter(F.col("edges") > task_edges).select("e1", "e2", "score"), "large"), shelf))
    return out


def match_entities(left: DataFrame, right: DataFrame, left_cols=("id", "current_name", "lat", "lon"), right_cols=("id", "alternative_name", "lat_noise", "lon_noise"), window: int = 6, threshold: float = 6.0, same_source: float = 8.5) -> DataFrame:
    """(left_id, right_id, confidence): ids of two sources that mean the same entity.

    Records are compared within ``window`` places of each other in each sort
    order.  Records of one source with at least ``same_source`` evidence are one
    entity; entities of the two sources are assigned one to one with the
    greatest total confidence, from pairs of at least ``threshold``; the result
    lists all ids of assigned entities, each pair once.

    Null ids are ignored; of a repeated id the latest row counts; null, empty,
    NaN or unreadable fields are no evidence either way; very long texts are
    compared by their words and grams; columns that are missing count as null,
    other columns are ignored; an empty side gives an empty result.
    """
    shelf = Shelf(left.sparkSession, "match")
    rows = records(left, 0, *left_cols).unionByName(records(right, 1, *right_cols))
    rows = without_empty_trades(shelf.put(rows, "records"))
    rows = with_core(shelf.put(rows, "trades")).withColumnRenamed("id", "own_id")
    rows = shelf.put(rows.withColumn("id", F.monotonically_increasing_id()), "fields")  # ids of the two sources may coincide, and be of any size
    scored = shelf.put(scored_neighbours(rows, shelf, window, threshold), "scored")
    same = scored.filter((F.col("s1") == F.col("s2")) & (F.col("score") >= same_source))
    entity = connected_components(same, "id1", "id2", rows.select("id"), shelf).select("id", F.col("group_id").alias("e"))
    entity = shelf.put(entity.join(rows.select("id", "src", "own_id"), "id"), "entities")
    of = lambda k: entity.select(F.col("id").alias(f"id{k}"), F.col("e").alias(f"e{k}"))
    confidence = scored.filter(F.col("s1") != F.col("s2")).join(of(1), "id1").join(of(2), "id2").select("e1", "e2", "score")
    one = assign(confidence, shelf)
    ids = lambda s, e, i: entity.filter(F.col("src") == s).select(F.col("e").alias(e), F.col("own_id").alias(i))
    return one.join(ids(0, "e1", "left_id"), "e1").join(ids(1, "e2", "right_id"), "e2").select("left_id", "right_id", F.col("score").alias("confidence"))
