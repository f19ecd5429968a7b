"""Secret scans: base patterns plus character Markov models (DataFrame operations only).

Two first-order Markov models over ASCII characters, one of random strings and one of
ordinary identifiers, are trained from labelled samples.  A candidate string is
a secret when the log-likelihood ratio of the two models exceeds a threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import about, text_of

#: Base patterns, fixed by the contract.  Letters of the keyword in either case.
KEYWORD = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
BEFORE_VALUE = KEYWORD + r"[\"']?\x20*[:=]\x20*[\"']?"
ASSIGN = BEFORE_VALUE + "[A-Za-z0-9+/_.=-]+"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: A value of 12 or more characters closes the match.
ASSIGN_PASSES = "^" + BEFORE_VALUE + "[A-Za-z0-9+/_.=-]{12,}$"
#: The same matches where failing ones can't hold a passing one: a run of the class is one match.
ACCESS_LONG = "AKIA[A-Z0-9]{14,}"
HEX_LONG = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
SYMBOLS = 66  # characters of the candidate's class and the start


def _bigrams(token: str) -> Column:
    """Codes previous * 128 + next of each step; the start counts as code 0."""
    codes = F.transform(F.split(F.col(token), ""), F.ascii)
    return F.transform(codes, lambda c, i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(codes, i)) * 128 + c)


def train(samples: DataFrame, backoff: float = 4.0) -> list[float]:
    """Log-likelihood ratio of each step, from rows (token, label); label 1 marks random strings.

    The counts are of two times 128 * 128 steps at most, whatever the number of rows.
    Null and empty tokens are passed over; characters outside ASCII count as code 127.
    """
    tokens = samples.where(F.length("token") > 0).select(F.regexp_replace("token", r"[^\x00-\x7F]", "\x7f").alias("token"), F.col("label").cast("int").alias("label"))
    steps = tokens.select("label", F.explode(_bigrams("token")).alias("step")).groupBy("label", "step").count().collect()
    count = [[0] * (128 * 128), [0] * (128 * 128)]
    for label, step, n in steps:
        if label in (0, 1):
            count[label][step] += n
    # a step is backed off to how often its character occurs at all
    single = []
    for label in (0, 1):
        seen = [sum(count[label][c::128]) for c in range(128)]
        single.append([(n + 0.5) / (sum(seen) + 0.5 * SYMBOLS) for n in seen])
    ratio = [0.0] * (128 * 128)
    for before in range(128):
        row = slice(before * 128, before * 128 + 128)
        total = [sum(count[label][row]) + backoff for label in (0, 1)]
        for step in range(row.start, row.stop):
            after = step - row.start
            random, ordinary = ((count[label][step] + backoff * single[label][after]) / total[label] for label in (1, 0))
            ratio[step] = math.log(random) - math.log(ordinary)
    return ratio


def random_strings(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Labelled random strings: digests written in base 64, base 16 and capitals with digits."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    kinds = F.array(base64, F.substring(digest, 1, 40), F.substring(F.upper(F.regexp_replace(base64, "[+/]", "7")), 1, 20))
    return spark.range(n).select(F.explode(kinds).alias("token"), F.lit(1).alias("label"))


def labelled_samples(docs: DataFrame, text_col: str = "text", key: str = "doc_id", rows: int = 4000) -> DataFrame:
    """Samples for ``train``: random strings, what the base patterns find, and ordinary words.

    Read from about ``rows`` documents chosen by a hash of their key; ordinary words
    are those of 6 or more letters in which no base pattern matches.
    """
    some = about(docs.select(key, text_col), key, rows, "secret").select(text_of(text_col).alias("t"))
    found = F.concat(F.regexp_extract_all("t", F.lit(ACCESS_LONG), F.lit(0)), F.regexp_extract_all("t", F.lit(HEX_LONG), F.lit(0)))
    bare = F.regexp_replace("t", "|".join((ASSIGN, ACCESS_LONG, HEX_LONG)), " ")
    words = F.regexp_extract_all(bare, F.lit("[A-Za-z_-]{6,}"), F.lit(0))
    return (
        random_strings(docs.sparkSession)
        .unionByName(some.select(F.explode(found).alias("token"), F.lit(1).alias("label")))
        .unionByName(some.select(F.explode(words).alias("token"), F.lit(0).alias("label")))
    )


SPANS = "array<struct<s:int,k:int,e:int>>"
#: Spans that are appended one by one before they go to the list of full blocks, so that appending costs no copy of all.
BLOCK = 64


def _empty(kind: str) -> Column:
    return F.from_json(F.lit("[]"), kind)


def _appended(so_far, span, when) -> tuple[Column, Column]:
    """(open block, full blocks) with ``span`` added where ``when``."""
    longer = F.concat(so_far["open"], F.array(span))
    full = F.size(so_far["open"]) >= BLOCK - 1
    open_ = F.when(when, F.when(full, _empty(SPANS)).otherwise(longer)).otherwise(so_far["open"])
    blocks = F.when(when & full, F.concat(so_far["full"], F.array(longer))).otherwise(so_far["full"])
    return open_.alias("open"), blocks.alias("full")


def _all(so_far) -> Column:
    return F.concat(F.flatten(so_far["full"]), so_far["open"])


def _located(text: Column, pattern: str, kind: int, passes) -> Column:
    """array<struct<s,k,e>> of the matches of ``pattern`` for which ``passes(match)``; code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def step(so_far, pair):
        start = so_far["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        span = F.struct(start.alias("s"), F.lit(kind).alias("k"), end.alias("e"))
        return F.struct(end.alias("at"), *_appended(so_far, span, F.coalesce(passes(pair["match"]), F.lit(False))))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), _empty(SPANS).alias("open"), _empty(f"array<{SPANS}>").alias("full")), step, _all)


def _fresh(base: Column, markov: Column) -> Column:
    """The Markov spans that overlap no base span: one pass over both lists, merged by start.

    ``reach`` is the farthest end of a base span so far; a Markov span waits until the next span shows whether a base
    span begins within it.
    """
    none = F.struct(F.lit(-1).alias("s"), F.lit(3).alias("k"), F.lit(-1).alias("e"))

    def step(so_far, x):
        is_base = x["k"] < 3
        waits = so_far["wait"]["s"] >= 0
        clear = waits & (x["s"] >= so_far["wait"]["e"])  # no later span can begin within what waits
        wait = F.when(~is_base, F.when(x["s"] < so_far["reach"], none).otherwise(x)).when(clear, none).when(waits, none).otherwise(so_far["wait"])
        reach = F.when(is_base, F.greatest(so_far["reach"], x["e"])).otherwise(so_far["reach"])
        return F.struct(reach.alias("reach"), wait.alias("wait"), *_appended(so_far, so_far["wait"], clear))

    def close(so_far):
        return F.concat(_all(so_far), F.when(so_far["wait"]["s"] >= 0, F.array(so_far["wait"])).otherwise(_empty(SPANS)))

    start = F.struct(F.lit(-1).alias("reach"), none.alias("wait"), _empty(SPANS).alias("open"), _empty(f"array<{SPANS}>").alias("full"))
    return F.aggregate(F.array_sort(F.concat(base, markov)), start, step, close)


def _joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, ratio: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = 12.0, distinct: int = 8) -> DataFrame:
    """(id, text, base_spans, spans) of every row; spans are array<struct<s start, k kind, e end>>, by start, kind.

    A null text is empty and has no spans; repeated rows give repeated results, an empty table none; other columns
    are ignored, whatever their names.  Very long texts are scanned whole, in time proportional to their length and spans.  Markov spans are strings of ``CANDIDATE`` with at
    least ``distinct`` different characters (a row of one character is regular, not
    random) whose log-likelihood ratio is ``threshold`` or more (a tie with it counts); one that overlaps a base
    span is left out.  Offsets count code points, the end is exclusive.
    """
    table = F.from_json(F.lit(str([round(x, 6) for x in ratio])), "array<double>")
    none = _empty(SPANS)

    def score(token):
        codes = F.transform(F.split(token, ""), F.ascii)
        steps = F.transform(codes, lambda c, i: F.element_at(table, F.when(i == 0, F.lit(0)).otherwise(F.element_at(codes, i)) * 128 + c + 1))
        return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)

    def secret(token):
        return (score(token) >= threshold) & (F.size(F.array_distinct(F.split(token, ""))) >= distinct)

    t = F.col("_t")
    out = docs.select(F.col(id_col), F.col(text_col).alias("text"), text_of(text_col).alias("_t"))
    out = out.withColumn("_assign", F.when(t.rlike(ASSIGN), _located(t, ASSIGN, 0, lambda m: m.rlike(ASSIGN_PASSES))).otherwise(none))
    out = out.withColumn("_access", F.when(F.contains(t, F.lit("AKIA")), _located(t, ACCESS_LONG, 1, lambda m: F.lit(True))).otherwise(none))
    out = out.withColumn("_hex", F.when(t.rlike(HEX_LONG), _located(t, HEX_LONG, 2, lambda m: F.lit(True))).otherwise(none))
    out = out.withColumn("base_spans", F.array_sort(F.concat("_assign", "_access", "_hex")))
    out = out.withColumn("_any", F.exists(F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)), secret))
    out = out.withColumn("_markov", F.when(F.col("_any"), _located(t, CANDIDATE, 3, secret)).otherwise(none))
    fresh = F.when(F.size("_markov") > 0, _fresh(F.col("base_spans"), F.col("_markov"))).otherwise(none)
    out = out.withColumn("spans", F.array_sort(F.concat("base_spans", fresh)))
    return out.drop("_t", "_assign", "_access", "_hex", "_any", "_markov")


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the contract, derived from the spans of ``scan``."""

    def count(kind):
        return F.size(F.filter("base_spans", lambda x: x["k"] == kind)).cast("long")

    return scanned.select(
        id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["k"] == 3)).cast("long").alias("n_markov"),
    )
