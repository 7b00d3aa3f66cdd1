"""Secret scans with DataFrame functions only.

Base patterns give spans of three kinds.  Other long tokens are tested for
randomness: the encoding is inferred from their characters, and chi-squared
uniformity over its alphabet, a runs test (lower against upper half of the
alphabet) and lag-1 serial correlation are combined (three times the least
p-value).  Tokens of letters only hold few letters for a test of uniformity;
they also meet a test of letter frequencies (the mean log share in written
text against a uniform draw; four times the least p-value).  Under the hypothesis "drawn at random" words, identifiers and
sequences have tiny p-values.  They are dismissed by Benjamini-Hochberg within
bands of alphabet and token length -- short tokens give weak tests and are not
pooled with long ones, nor words with encodings -- so at most a share of about ``FDR`` of what is dismissed would be
truly random; tokens that are not dismissed are reported as ``random``.
Band sizes come from a p-value histogram of fixed size over all texts.

Positions: a text split at a pattern, and the pattern's matches, alternate;
running sums of their lengths (in code points) are the spans.

Defined cases: null text counts as empty and has no spans; repeated rows and
null doc_ids are scanned like any other row; tokens that touch a base span
are not tested; no rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from revisit.llm.store import stored

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"         # the whole run of 20 or more characters
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE = 6
FDR = 0.05
# Alphabets by name, in order of inference: the first that holds all of a token.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base36_upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64url": "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}
LETTERS_ONLY = [i for i, name in enumerate(ALPHABETS) if name in ("lower", "upper", "letters")]
# Letters a to z in a thousand of written English, for the letter test (other Latin scripts are close enough).
LETTER_SHARES = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
LETTER_LOGS = [math.log(x) for x in LETTER_SHARES]
LETTER_MEAN = sum(LETTER_LOGS) / 26
LETTER_VARIANCE = sum((x - LETTER_MEAN) ** 2 for x in LETTER_LOGS) / 26
CAPITAL_LOG = math.log(1 / 20)       # a capital against a small letter, where a token has both
CHUNK = 512
P_STEPS = 8            # histogram steps per factor of two in p
P_BINS = 480
BANDS = 40             # of an alphabet, by the binary logarithm of the length, in half steps


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, first: Column) -> Column:
    """Sum of ``first`` and all values before each value."""
    start = F.struct(first.cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
    return F.aggregate(values, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
                       lambda acc: acc["out"])


def prefix_sums(values: Column) -> Column:
    """Sum of the values before each value, in chunks (arrays only grow by appending)."""
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / CHUNK), F.lit(0)).cast("int")),
                         lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))
    return let(chunks, lambda parts: let(
        running(F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)),
        lambda bases: F.flatten(F.zip_with(parts, bases, running))))


def matches(text: Column, pattern: str, present: Column, kind: int) -> Column:
    """Spans of the leftmost non-overlapping matches: (start, kind, end, value)."""
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def spans(m: Column, gaps: Column) -> Column:
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: (F.length(g) + F.length(x)).cast("long"))
        return F.zip_with(F.zip_with(prefix_sums(lengths), lengths, lambda a, n: a + n), m, lambda end, x: F.struct(
            (end - F.length(x)).cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"), x.alias("value")))
    return F.when(present, let(found, lambda m: F.when(F.size(m) > 0, let(between, lambda gaps: spans(m, gaps))).otherwise(empty))).otherwise(empty)


def base_spans(text: Column) -> Column:
    assign = matches(text, ASSIGN, text.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"), 0)
    assign = F.filter(assign, lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= MIN_VALUE)
    access = matches(text, ACCESS, text.contains("AKIA"), 1)
    hexes = matches(text, HEX, text.rlike(HEX), 2)
    return F.concat(assign, access, hexes)


def tail(z: Column) -> Column:
    """Two-sided normal p-value (rational approximation of erfc)."""
    def area(x: Column, t: Column) -> Column:
        poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
        return F.least(F.lit(1.0), F.greatest(F.lit(1e-18), poly * F.exp(-x * x)))
    return let(F.abs(z) / math.sqrt(2), lambda x: let(1 / (1 + 0.3275911 * x), lambda t: area(x, t)))


def battery(token: Column, alphabet: Column, letters_only: Column) -> Column:
    """Combined p-value of the tests for one alphabet."""
    n = F.length(token).cast("double")

    def z_uniform(k: Column) -> Column:
        squares = F.aggregate(F.array_distinct(F.split(token, "")), F.lit(0.0), lambda acc, c: F.when(c == "", acc).otherwise(
            acc + F.pow((n - F.length(F.replace(token, c, F.lit("")))), F.lit(2.0))))
        spread = F.lit(2.0) / (9 * (k - 1))
        return (F.pow(F.greatest(k / n * squares - n, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)

    def z_runs(bits: Column) -> Column:
        def made(ones: Column) -> Column:
            changes = sum(((n - F.length(F.replace(bits, F.lit(p), F.lit("")))) / 2 for p in ("01", "10")), F.lit(0.0))
            return let(2 * ones * (n - ones), lambda product: let(
                product * (product - n) / (n * n * (n - 1)), lambda variance: F.when(
                    variance > 0, (changes - product / n) / F.sqrt(variance)).otherwise(F.lit(9.0))))
        return let(F.length(F.replace(bits, F.lit("0"), F.lit(""))).cast("double"), made)

    def z_serial(x: Column) -> Column:
        return let(F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n, lambda mean: let(
            F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)), lambda var: F.when(
                var > 0, F.sqrt(n) * F.aggregate(
                    F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x)), lambda u, v: (u - mean) * (v - mean)),
                    F.lit(0.0), lambda a, v: a + v) / var).otherwise(F.lit(9.0))))

    def z_letters() -> Column:
        logs = F.array(*[F.lit(x) for x in LETTER_LOGS])
        total = F.aggregate(F.filter(F.split(F.lower(token), ""), lambda c: c != ""), F.lit(0.0), lambda a, c: a + F.get(logs, F.ascii(c) - 97))
        capitals = n - F.length(F.regexp_replace(token, "[A-Z]", ""))
        both = F.when(F.length(alphabet) == 52, F.lit(1.0)).otherwise(F.lit(0.0))
        mean = LETTER_MEAN + both * CAPITAL_LOG / 2
        return (total + both * CAPITAL_LOG * capitals - n * mean) / F.sqrt(n * (LETTER_VARIANCE + both * CAPITAL_LOG ** 2 / 4))

    def tests(places: Column) -> Column:
        half = F.length(alphabet) / 2
        bits = F.array_join(F.transform(places, lambda v: F.when(v > half, F.lit("1")).otherwise(F.lit("0"))), "")
        least = F.least(tail(z_uniform(F.length(alphabet).cast("double"))), tail(let(bits, z_runs)), tail(z_serial(places)))
        return let(least, lambda p: F.least(F.lit(1.0), F.when(letters_only, 4 * F.least(p, tail(z_letters()))).otherwise(3 * p)))
    return let(F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c).cast("double")), tests)


def inferred(token: Column) -> Column:
    """Number of the first alphabet that holds the token, or null."""
    which = F.lit(None).cast("int")
    for i, letters in reversed(list(enumerate(ALPHABETS.values()))):
        inside = "^[" + letters.replace("-", "").replace("/", "\\/") + ("-" if "-" in letters else "") + "]+$"
        which = F.when(token.rlike(inside), F.lit(i)).otherwise(which)
    return which


def randomness(token: Column) -> Column:
    """(alphabet number, combined p-value), nulls without an alphabet."""
    names = F.array(*[F.lit(x) for x in ALPHABETS.values()])
    return let(inferred(token), lambda which: F.struct(which.alias("alphabet"), F.when(which.isNotNull(), let(
        F.get(names, which), lambda a: battery(token, a, which.isin(LETTERS_ONLY)))).alias("p")))


def largest_before(values: Column) -> Column:
    """Largest of the values before each value, or -1, in chunks like ``prefix_sums``."""
    def walk(part: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct(F.greatest(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
                           lambda acc: acc["out"])
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / CHUNK), F.lit(0)).cast("int")),
                         lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))
    return let(chunks, lambda parts: let(walk(F.transform(parts, F.array_max), F.lit(-1)), lambda bases: F.flatten(F.zip_with(parts, bases, walk))))


def outside(tokens: Column, base: Column) -> Column:
    """Tokens that share no character with a base span.  Both are laid in one
    order of starts; a token is free if no base span before it ends inside and
    the next one starts behind it: no token meets every base span."""
    def laid(spans: Column, is_base: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(is_base).alias("base"), s["end"].alias("end"), s["value"].alias("value")))

    def free(events: Column) -> Column:
        ends = largest_before(F.transform(events, lambda e: F.when(e["base"], e["end"]).otherwise(F.lit(-1))))
        last = F.lit((1 << 31) - 1)
        starts = F.reverse(largest_before(F.transform(F.reverse(events), lambda e: F.when(e["base"], last - e["start"]).otherwise(F.lit(-1)))))
        marked = F.zip_with(F.zip_with(events, ends, lambda e, x: F.struct(e.alias("e"), x.alias("ends"))), starts, lambda e, x: F.struct(
            e["e"].alias("t"), (~e["e"]["base"] & (e["ends"] <= e["e"]["start"]) & ((x < 0) | (last - x >= e["e"]["end"]))).alias("free")))
        return F.transform(F.filter(marked, lambda m: m["free"]), lambda m: F.struct(
            m["t"]["start"].alias("start"), F.lit(3).alias("kind"), m["t"]["end"].alias("end"), m["t"]["value"].alias("value")))
    met = F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens)
    return met.otherwise(let(F.array_sort(F.concat(laid(tokens, False), laid(base, True))), free))


def candidates(text: Column, base: Column) -> Column:
    """Tested tokens: (start, end, p, band)."""
    free = let(matches(text, TOKEN, text.rlike(TOKEN), 3), lambda tokens: outside(tokens, base))
    tested = F.transform(free, lambda t: let(let(F.rtrim(t["value"], F.lit("=")), randomness), lambda r: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), r["p"].alias("p"),
        (r["alphabet"] * BANDS + F.least(F.lit(BANDS - 1), F.floor(2 * F.log2((t["end"] - t["start"]).cast("double"))))).cast("int").alias("band"))))
    return F.filter(tested, lambda t: t["p"].isNotNull())


def p_bin(p: Column) -> Column:
    """Histogram bin of a p-value: 0 at p = 1, larger for smaller p."""
    return F.least(F.lit(P_BINS), F.greatest(F.lit(0), F.floor(-P_STEPS * F.log2(p)))).cast("int")


def dismissal_bins(scanned: DataFrame, fdr: float = FDR) -> list[int]:
    """For each band (alphabet and length) the least bin whose tokens are dismissed
    (Benjamini-Hochberg at the bins' upper edges; P_BINS + 1: none)."""
    counts = (scanned.select(F.explode("tested").alias("t")).groupBy(F.col("t.band").alias("band"), p_bin(F.col("t.p")).alias("bin"))
              .agg(F.count(F.lit(1)).alias("n")))              # at most alphabets x BANDS x (P_BINS + 1) rows
    by_band = Window.partitionBy("band")
    ranked = (counts.withColumn("smaller", F.sum("n").over(by_band.orderBy(F.desc("bin"))))
              .withColumn("m", F.sum("n").over(by_band)))
    edge = F.pow(F.lit(2.0), -F.col("bin") / F.lit(float(P_STEPS)))
    least = (ranked.where(edge <= F.lit(fdr) * F.col("smaller") / F.col("m")).groupBy("band").agg(F.min("bin").alias("bin")))
    bins = [P_BINS + 1] * (len(ALPHABETS) * BANDS)
    for r in least.collect():
        bins[r["band"]] = r["bin"]
    return bins


def with_scan(docs: DataFrame) -> DataFrame:
    """``docs`` and ``base``, ``tested``; helper names must be free (see callers)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("base", base_spans(text)).withColumn("tested", candidates(text, F.col("base")))


def kept_random(bins: list[int]) -> Column:
    limits = F.array(*[F.lit(b) for b in bins])
    passed = F.filter("tested", lambda t: p_bin(t["p"]) < F.get(limits, t["band"]))
    return F.transform(passed, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))


def sorted_base() -> Column:
    return F.array_sort(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, digest of the base spans, all spans."""
    narrow = with_scan(docs.select("doc_id", "text")).select("doc_id", sorted_base().alias("base"), "tested")
    scanned = stored(narrow, "secrets")
    bins = dismissal_bins(scanned)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    every = F.array_sort(F.concat(F.col("base"), kept_random(bins)))
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                          F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(every).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; other texts
    are left as they are.  Overlapping spans are replaced once."""
    held = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").alias("text"))
    scanned = stored(with_scan(held).select("doc", sorted_base().alias("base"), "tested"), "secret-spans")   # each text is scanned once
    spans, text = F.array_sort(F.concat(F.col("base"), kept_random(dismissal_bins(scanned)))), F.col("doc")["text"]

    def replace(text: Column, spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
        return F.aggregate(spans, start, lambda acc, s: F.when(s["start"] < acc["at"], F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(
                s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).alias("out"))),
            lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return scanned.select("doc", spans.alias("spans")).select("doc", F.when(F.size("spans") > 0, replace(text, F.col("spans"))).otherwise(text).alias("new")).select(*[
        (F.col("new") if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns])
