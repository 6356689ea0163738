"""Secret scanning with fixed patterns and character Markov models. DataFrame functions only.

Two first-order models over the letters of ALPHABET, one of random strings and
one of ordinary identifiers, are counted from labelled samples. Runs of such
letters in what the fixed patterns leave of a text are secrets if their log-likelihood ratio,
in total and for each letter, favours the random model. Every step takes time in
proportion to the text: spans come from running sums, what is known is blanked out in place, and letters are read as pairs.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the three base kinds, and the least code points of what must be long.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ["assign", "access", "hex", "markov"]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Runs that the models judge, and the letters that ordinary samples have at least.
RUN, RUN_LEAST, WORD_LEAST = r"[A-Za-z0-9+/_=-]", 16, 6
_SPANS = "array<struct<start:int,no:int,end:int,value:string,score:double>>"
#: Array elements that a fold appends to one by one; longer arrays are folded in such blocks.
FOLD = 128
#: Stands for each letter that a base span covers.
BLANK = "\x01"
_FIRST, _WIDTH = ord("+"), ord("z") - ord("+") + 1


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sums_before(steps: Column) -> Column:
    """For each element of an array of numbers the sum of those before it."""

    def grow(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(F.element_at(acc, -1) + x))

    zero = F.array(F.lit(0))
    blocks = lambda a: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(a) / FOLD).cast("int") - 1)), lambda k: F.aggregate(F.slice(a, k * FOLD + 1, F.lit(FOLD)), zero, grow))
    offsets = lambda own: F.aggregate(own, zero, lambda acc, w: grow(acc, F.element_at(w, -1)))
    whole = lambda own: F.flatten(F.zip_with(own, F.slice(offsets(own), F.lit(1), F.size(own)), lambda w, o: F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x: x + o)))
    return _let(steps, lambda a: _let(blocks(a), whole))


def found(text: str, pattern: str, no: int) -> Column:
    """Leftmost matches of pattern in column text with their code point bounds; pattern never matches an empty string."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(hit: Column) -> Column:
        gap = F.transform(F.slice(pieces, F.lit(1), F.size(hit)), F.length)
        return _let(gap, lambda g: F.transform(F.arrays_zip(g.alias("g"), hit.alias("h"), sums_before(F.zip_with(g, hit, lambda x, y: x + F.length(y))).alias("b")), span))

    def span(x: Column) -> Column:
        a = x["b"] + x["g"]
        return F.struct(a.alias("start"), F.lit(no).alias("no"), (a + F.length(x["h"])).alias("end"), x["h"].alias("value"), F.lit(None).cast("double").alias("score"))

    return F.when(F.rlike(F.col(text), F.lit(pattern)), _let(hits, spans)).otherwise(F.array().cast(_SPANS))


def base_spans(rows: DataFrame) -> DataFrame:
    """rows (text) with base: the spans of the fixed kinds, by start and kind; rest: the text with BLANK for every letter of theirs.

    Also blank are letters directly beside a span that are too few for one of their own, where two spans would overlap.
    """
    # Runs of one class are maximal, so a least length in the pattern drops the same matches as a filter afterwards.
    long_hex, long_access = f"[0-9a-f]{{{LEAST['hex']},}}", f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}"
    values = F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))
    every = F.arrays_zip(F.col("assign_all").alias("span"), values.alias("value"))
    good = F.transform(F.filter(every, lambda x: F.length(x["value"]) >= LEAST["assign"]), lambda x: x["span"])
    rows = rows.withColumn("assign_all", found("text", ASSIGN, 0))
    assign = F.when(F.size("assign_all") > 0, good).otherwise(F.array().cast(_SPANS))
    rows = rows.withColumn("base", F.array_sort(F.concat(assign, found("text", long_access, 1), found("text", long_hex, 2))))
    gaps = F.zip_with(F.split("text", ASSIGN, -1), values, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    blank = F.zip_with(gaps, "assign_all", lambda g, s: F.concat(g["gap"], F.when(F.length(g["value"]) >= LEAST["assign"], F.repeat(F.lit(BLANK), F.length(s["value"]))).otherwise(F.coalesce(s["value"], F.lit("")))))
    rows = rows.withColumn("rest", F.when(F.size("assign_all") > 0, F.array_join(blank, "")).otherwise(F.col("text")))
    for pattern in (f"{long_access}|AKIA[A-Z0-9]*(?={BLANK})", f"{long_hex}|(?<={BLANK})[0-9a-f]+|[0-9a-f]{{{LEAST['hex'] - 1}}}(?={BLANK})"):
        rows = rows.withColumn("rest", F.when(F.size("base") > 0, blanked("rest", pattern)).otherwise(F.col("rest")))
    return rows.drop("assign_all")


def blanked(text: str, pattern: str) -> Column:
    """Column text with BLANK for each letter that pattern matches."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gone = F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.concat(gap, F.coalesce(F.repeat(F.lit(BLANK), F.length(hit)), F.lit(""))))
    return F.when(F.rlike(F.col(text), F.lit(pattern)), F.array_join(gone, "")).otherwise(F.col(text))


def samples_of(docs: DataFrame, *, most: int = 5_000, synthetic: int = 2_000, text: str = "text") -> DataFrame:
    """(text, is_random): labelled samples from at most `most` documents (those of the smallest hash of doc_id) and seeded random strings.

    Random: what the fixed patterns match, and for each of `synthetic` numbers its
    SHA-256 in hexadecimal, in base 64, and in capitals and digits. Ordinary: runs of WORD_LEAST letters or more outside these matches.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("_d")).where("_d is not null").distinct().orderBy(F.xxhash64("_d"), "_d").limit(most)
    clean = docs.select(F.col("doc_id").cast("long").alias("_d"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = base_spans(clean.join(F.broadcast(ids), "_d").select("text"))  # at most `most` ids
    values = F.transform("base", lambda s: F.when(s["no"] == 0, F.regexp_extract(s["value"], ASSIGN, 2)).otherwise(s["value"]))
    known = rows.select(F.explode(values).alias("text"), F.lit(True).alias("is_random"))
    plain = rows.select(F.explode(F.regexp_extract_all("rest", F.lit(f"{RUN}{{{WORD_LEAST},}}"), F.lit(0))).alias("text"), F.lit(False).alias("is_random"))
    sha = docs.sparkSession.range(synthetic).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    b64 = F.base64(F.unhex("h"))
    made = sha.select(F.explode(F.array("h", b64, F.upper(F.regexp_replace(b64, "[+/=]", "")))).alias("text"), F.lit(True).alias("is_random"))
    return known.unionByName(plain).unionByName(made)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of each pair of letters, row by row of the letter before; counts are smoothed by a half.

    samples: text and is_random; nulls and texts of under two letters teach nothing. At most
    two counts for each pair come to the driver.
    """
    n = len(ALPHABET)
    at = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    pairs = samples.where("is_random is not null and length(text) > 1")
    counts = pairs.select("is_random", F.explode(pairs_of(F.col("text"))).alias("pair")).groupBy("is_random", "pair").agg(F.count("*").alias("c"))
    counts = counts.select("is_random", at(F.substring("pair", 1, 1)).alias("a"), at(F.substring("pair", 2, 1)).alias("b"), "c").where("a >= 0 and b >= 0")
    table = {True: [[0.5] * n for _ in range(n)], False: [[0.5] * n for _ in range(n)]}
    for r in counts.collect():
        table[r.is_random][r.a][r.b] += r.c
    ratio = lambda a, b: log(table[True][a][b] / sum(table[True][a])) - log(table[False][a][b] / sum(table[False][a]))
    return [round(ratio(a, b), 6) for a in range(n) for b in range(n)]


def pairs_of(text: Column) -> Column:
    """Every two neighbouring letters."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), F.lit(1))


def log_ratio(text: Column, model: list[float]) -> Column:
    """Sum of the model's ratios over the pairs of letters of text, all in ALPHABET."""
    cells = [0.0] * _WIDTH**2
    for i, a in enumerate(ALPHABET):
        for k, b in enumerate(ALPHABET):
            cells[(ord(a) - _FIRST) * _WIDTH + ord(b) - _FIRST] = model[i * len(ALPHABET) + k]
    table = F.split(F.lit(",".join(map(str, cells))), ",").cast("array<double>")
    at = lambda c: F.ascii(c) - _FIRST
    return F.aggregate(pairs_of(text), F.lit(0.0), lambda acc, p: acc + F.get(table, at(p) * _WIDTH + at(F.substring(p, 2, 1))))


def find_secrets(docs: DataFrame, model: list[float], *, text: str = "text", total: float = 10.0, each: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, n_markov, base and spans (start, end, value, kind, score), by start and kind.

    A run of RUN_LEAST letters or more in what base spans leave of the text is a span of kind markov if its
    log-likelihood ratio is at least total, and at least each for every letter. Bounds are code points, the end is
    exclusive. Null and empty texts have no spans; null doc_ids stay; repeated rows repeat; other columns
    are not read; an empty table gives an empty result. No shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = base_spans(rows).withColumn("runs", found("rest", f"{RUN}{{{RUN_LEAST},}}", 3)).drop("text", "rest")
    scored = F.transform("runs", lambda s: s.withField("score", log_ratio(s["value"], model)))
    good = lambda s: (s["score"] >= total) & (s["score"] >= each * (s["end"] - s["start"]))
    rows = rows.withColumn("markov", F.filter(scored, good))
    count = lambda no: F.size(F.filter("base", lambda s: s["no"] == no)).cast("long")
    names = F.array(*map(F.lit, KINDS))
    named = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["no"]).alias("kind"), s["value"].alias("value"), s["score"].alias("score")))
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.size("markov").cast("long").alias("n_markov"), named("base").alias("base"), named(F.array_sort(F.concat("base", "markov"))).alias("spans"))


def written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest_of(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"), "n_markov")
