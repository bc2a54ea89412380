"""Secret scans with DataFrame functions alone.

Three fixed patterns give the base spans. A pair of character Markov models adds more: every token
of ``LEAST['assign']`` characters or more outside the base spans is scored by the log-likelihood
ratio of a model of random strings to a model of ordinary identifiers. Both are trained here from
labelled tokens: ordinary are the tokens of all documents outside base spans, also capitalised and in capitals, and identifiers (camel case, constants, paths) put together from common
words; random are the values in base spans and strings drawn from a hash over the alphabets that
secrets use. Each pair of characters costs what ordinary tokens reach per pair, so that a long
ordinary token doesn't pass by its length, and the threshold comes from tokens that the models have
not seen.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

# The base patterns and the least length of what must match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Tokens that the models judge, letters alone included.
CANDIDATE = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST['assign']},}}"
DRAWN = 1_000  # strings drawn for each alphabet
CODES = 128  # the models' alphabet is ASCII
ODDS = math.log(1e4)  # a span is added from this log-likelihood ratio at least: one token in 10,000 is a secret
ORDINARY = 0.9999  # and from what this share of held-out ordinary tokens stays under
PER_PAIR = 0.99  # a pair of characters costs what this share of held-out ordinary tokens stays under, on average over their pairs
MASK = "[SECRET]"

# Labelled sample: common words of ordinary identifiers.
WORDS = """
about access action active after amount application array attribute available balance batch between binary body bottom
branch buffer build bytes calendar camera center change character child class clock collection command common company
config connection context convert country current customer default delivery depth design device different directory
display domain double driver element email encoding engine environment event example execute expected extension
factory failure feature field final format forward function gateway global group handler header health history icon
identity import index input integer interface invoice item journal knowledge label large layer length library limit
local location logical manager maximum medical member message minimum mobile module monitor name network node
notification number observation operation option organization output page parent parser path pattern performance
picture pixel pointer policy previous priority process profile project protocol public quality query question quick
range reader reference region release render report resource response return root route schedule schema screen search
section select sequence service shadow shape single size source standard state status storage string style subject
support switch system target task template text thread title topic track traffic transfer transport tree type unique
update user utility value variable version video view visible volume weather weight widget window worker write
""".split()


_SPANS = "array<struct<kind:string,start:int,end:int,token:string>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row: an expression that stands in several places
    is computed in each, and within a lambda for each element."""
    return F.transform(F.array(value), use)[0]


def _matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """before and token of each of the leftmost non-overlapping matches, and what follows the last.

    ``split`` and ``regexp_extract_all`` walk the same matches."""
    parts = F.split(text, pattern, -1)
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pair = lambda a, t: F.struct(a.alias("before"), t.alias("token"))
    return _once(tokens, lambda ts: F.zip_with(F.slice(parts, 1, F.size(ts)), ts, pair)), F.element_at(parts, -1)


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """kind, start, end (code points), token of the matches: the lengths of the parts before and of
    the matches add up to positions. The matches are walked in blocks of about the root of their
    number, as each step copies what its block has so far."""
    pairs, _ = _matches(text, pattern)

    def blocks(ps: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(ps).cast("double"))).cast("int")
        return F.when(F.size(ps) > 0, _once(width, lambda w: F.transform(F.sequence(F.lit(0), F.size(ps) - 1, w), lambda k: F.slice(ps, k + 1, w))))

    def step(s: Column, p: Column) -> Column:
        at = s["at"] + F.length(p["before"])
        end = at + F.length(p["token"])
        here = F.struct(F.lit(kind).alias("kind"), at.alias("start"), end.alias("end"), p["token"].alias("token"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(here)).alias("out"))

    def block(done: Column, some: Column) -> Column:
        at = F.coalesce(F.try_element_at(done, F.lit(-1))["at"], F.lit(0))
        return F.concat(done, F.array(F.aggregate(some, F.struct(at.alias("at"), F.array().cast(_SPANS).alias("out")), step)))

    whole = F.aggregate(_once(pairs, blocks), F.array().cast(f"array<struct<at:int,out:{_SPANS}>>"), block, lambda s: F.flatten(F.transform(s, lambda x: x["out"])))
    return F.coalesce(whole, F.array().cast(_SPANS))


def _blanked(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """The text with as many spaces in place of each match, but for tokens that ``keep`` holds."""
    pairs, rest = _matches(text, pattern)
    space = lambda t: F.repeat(F.lit(" "), F.length(t))
    shown = lambda t: F.when(keep(t), t).otherwise(space(t)) if keep else space(t)
    return F.concat(F.array_join(F.transform(pairs, lambda p: F.concat(p["before"], shown(p["token"]))), ""), rest)


def _run(kind: str, pattern: str, taken: int = 0) -> str:
    """A run that is too short can't hold a longer one, so the least length can stand in the pattern."""
    return pattern.replace("+", f"{{{LEAST[kind] - taken},}}")


def outside(text: Column) -> Column:
    """The text with its base spans blanked."""
    short = lambda t: F.length(F.regexp_extract(t, ASSIGN, 2)) < LEAST["assign"]
    assign = lambda t: F.when(t.rlike(ASSIGN), _blanked(t, ASSIGN, short)).otherwise(t)
    access = lambda t: F.when(t.contains("AKIA"), _blanked(t, _run("access", ACCESS, 4))).otherwise(t)
    hexa = lambda t: F.when(t.rlike(_run("hex", HEX)), _blanked(t, _run("hex", HEX))).otherwise(t)
    return _once(_once(assign(text), access), hexa)


def _none() -> Column:
    return F.array().cast(_SPANS)


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of each kind. Documents without any match of the pattern skip the walk."""
    assign = F.filter(_spans(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["token"], ASSIGN, 2)) >= LEAST["assign"])
    access = _spans(text, _run("access", ACCESS, 4), "access")
    hexa = _spans(text, _run("hex", HEX), "hex")
    return {
        "assign": F.when(text.rlike(ASSIGN), assign).otherwise(_none()),
        "access": F.when(text.contains("AKIA"), access).otherwise(_none()),
        "hex": F.when(text.rlike(_run("hex", HEX)), hexa).otherwise(_none()),
    }


def drawn(spark: SparkSession, each: int = DRAWN) -> DataFrame:
    """token: strings drawn from a hash over the alphabets of secrets, 12 to 43 characters long."""
    text = F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256)))
    plain = F.regexp_replace(text, "[+/=]", "")
    kinds = [F.rtrim(F.lit("="), text), F.translate(F.rtrim(F.lit("="), text), "+/", "-_"), plain, F.lower(plain), F.upper(plain), F.regexp_replace(plain, "[^a-z]", ""), F.regexp_replace(plain, "[^A-Z]", ""), F.upper(F.sha2(F.col("id").cast("string"), 256)), F.sha2(F.col("id").cast("string"), 224)]
    made = spark.range(each).select("id", F.explode(F.array(*kinds)).alias("token"))
    least = LEAST["assign"]
    return made.select(F.substring("token", F.lit(1), (least + F.col("id") % (44 - least)).cast("int")).alias("token")).where(F.length("token") >= least)


def identifiers(spark: SparkSession, each: int = DRAWN) -> DataFrame:
    """token: ordinary identifiers of two to four of ``WORDS``, chosen by a hash, in each usual form,
    and rulers of one mark."""
    words = F.array(*[F.lit(w) for w in WORDS])
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    parts = spark.range(each).select(F.slice(F.array(*[word(k) for k in range(4)]), 1, (F.col("id") % 3 + 2).cast("int")).alias("w"))
    title = F.array_join(F.transform("w", F.initcap), "")
    camel = F.concat(F.element_at("w", 1), F.substring(title, F.length(F.element_at("w", 1)) + 1, F.length(title)))
    snake = F.array_join("w", "_")
    forms = [title, camel, snake, F.upper(snake), F.array_join("w", "-"), F.array_join("w", "/"), F.array_join("w", "")]
    rulers = spark.range(12, 81).select(F.explode(F.transform(F.array(*map(F.lit, "-_=/+")), lambda c: F.repeat(c, F.col("id").cast("int")))).alias("token"))
    return parts.select(F.explode(F.array(*forms)).alias("token")).unionByName(rulers)


def labelled(docs: DataFrame) -> DataFrame:
    """random (1 or 0), token, held (for calibration alone: a quarter of the tokens): the distinct
    labelled tokens of all documents, the ordinary ones also capitalised and in capitals, the drawn
    strings and the identifiers."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = base_spans(text)
    values = F.concat(
        F.transform(base["assign"], lambda s: F.regexp_extract(s["token"], ASSIGN, 2)),
        F.transform(base["access"], lambda s: s["token"]),
        F.transform(base["hex"], lambda s: s["token"]),
    )
    words = F.regexp_extract_all(outside(text), F.lit(r"[A-Za-z0-9+/_=-]{6,}"), F.lit(0))
    as_rows = lambda label, tokens: F.transform(tokens, lambda v: F.struct(F.lit(label).alias("random"), v.alias("token")))
    found = docs.select(F.explode(F.concat(as_rows(1, values), as_rows(0, words))).alias("x")).select("x.random", "x.token")
    made = drawn(docs.sparkSession).select(F.lit(1).alias("random"), "token")
    names = identifiers(docs.sparkSession).select(F.lit(0).alias("random"), "token")
    cased = F.when(F.col("random") == 0, F.array("token", F.initcap("token"), F.upper("token"))).otherwise(F.array("token"))
    found = found.distinct().select("random", F.explode(cased).alias("token"))
    return found.unionByName(made).unionByName(names).distinct().withColumn("held", F.pmod(F.xxhash64("token"), F.lit(4)) == 0)


def model(tokens: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio of each pair of characters, at 128 * first + second, from random, token.

    What comes to the driver is at most one row for each label and pair of ASCII characters.
    Without samples of a label its model is uniform."""
    letters = F.split("token", "")
    pairs = F.transform(F.arrays_zip(letters.alias("a"), F.slice(letters, 2, F.size(letters)).alias("b")), lambda p: F.concat(p["a"], p["b"]))
    counts = tokens.select("random", F.explode(pairs).alias("pair")).where(F.length("pair") == 2).groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()
    seen = [[0.0] * (CODES * CODES) for _ in range(2)]
    for r in counts:
        a, b = map(ord, r["pair"])
        if a < CODES and b < CODES:
            seen[r["random"]][a * CODES + b] += r["n"]
    alphabet = 66
    table = [0.0] * (CODES * CODES)
    totals = [[sum(s[a * CODES : (a + 1) * CODES]) for a in range(CODES)] for s in seen]
    for a in range(CODES):
        for b in range(CODES):
            p = [(seen[k][a * CODES + b] + smoothing) / (totals[k][a] + smoothing * alphabet) for k in range(2)]
            table[a * CODES + b] = round(math.log(p[1] / p[0]), 6)
    return table


def train(docs: DataFrame) -> tuple[list[float], float]:
    """The table of the ratio, less what a pair costs, and its threshold: ``ODDS``, or more where
    held-out ordinary tokens exceed it."""
    tokens = cut(labelled(docs))
    table = model(tokens.where(~F.col("held")).drop("held"))
    pairs = F.length("token") - 1
    ordinary = tokens.where(F.col("held") & (F.col("random") == 0) & (F.length("token") >= LEAST["assign"]))
    ordinary = cut(ordinary.select(ratio(F.col("token"), table).alias("r"), pairs.alias("pairs")))
    cost = max(0.0, ordinary.agg(F.percentile_approx(F.col("r") / F.col("pairs"), PER_PAIR, 100_000)).first()[0] or 0.0)
    most = ordinary.agg(F.percentile_approx(F.col("r") - F.col("pairs") * cost, ORDINARY, 100_000)).first()[0]
    return [round(x - cost, 6) for x in table], max(ODDS, most or 0.0)


def ratio(token: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of an ASCII token: the sum over its pairs of characters."""
    ratios = F.from_json(F.lit(json.dumps(table)), "array<double>")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda s, c: F.struct(
        F.ascii(c).alias("last"),
        (s["sum"] + F.when(s["last"] < 0, F.lit(0.0)).otherwise(F.element_at(ratios, s["last"] * CODES + F.ascii(c) + 1))).alias("sum"),
    )
    return F.aggregate(F.split(token, ""), start, step, lambda s: s["sum"])


def scan(docs: DataFrame, table: list[float] | None = None, odds: float = ODDS) -> DataFrame:
    """Add ``secrets``: spans (kind, start, end, token) by start, then kind as listed.

    Kinds are assign, access, hex and, for tokens outside those spans that the models hold to be
    random, markov. Without ``table`` the models are trained on ``docs``. A null or empty text has
    none. All rows and columns stay; a column named ``secrets`` is replaced.
    """
    if table is None:
        table, odds = train(docs)
    docs = docs.drop("secrets")
    text = F.coalesce(F.col("text"), F.lit(""))
    judged = lambda t: F.when(t.rlike(CANDIDATE), F.filter(_spans(t, CANDIDATE, "markov"), lambda s: ratio(s["token"], table) >= odds)).otherwise(_none())
    fresh = _once(outside(text), judged)
    found = docs.select("*", *[c.alias(f"__fg_{k}") for k, c in base_spans(text).items()], fresh.alias("__fg_fresh"))
    found = found.withColumn("__fg_all", F.concat("__fg_assign", "__fg_access", "__fg_hex", "__fg_fresh"))
    order = F.create_map(F.lit("assign"), F.lit(0), F.lit("access"), F.lit(1), F.lit("hex"), F.lit(2), F.lit("markov"), F.lit(3))
    keyed = F.transform("__fg_all", lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("nth"), s.alias("span")))
    secrets = F.transform(F.array_sort(keyed), lambda s: s["span"])
    return found.select(*docs.columns, secrets.alias("secrets"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of the rows of ``scan``."""
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), of("markov"))


def redact(found: DataFrame, mask: str = MASK) -> DataFrame:
    """Replace every span of ``secrets`` in text by ``mask``; spans that overlap are one. Drops ``secrets``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= s["at"], F.concat(F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.lit(mask))).otherwise("")
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], gap).alias("out"))

    whole = F.aggregate("secrets", start, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    text = F.when(F.size("secrets") > 0, whole).otherwise(F.col("text"))
    return found.select(*[text.alias("text") if c == "text" else F.col(c) for c in found.columns if c != "secrets"])
