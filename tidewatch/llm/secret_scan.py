"""Secret scanning with SQL functions alone.

Base patterns find assignments, access keys and long hex runs.  A battery of
randomness tests adds other tokens: each token of 20 or more characters that
mixes character classes gets an encoding (hex, base32, lower or upper
alphanumeric, base64), a chi-squared test of uniformity over that alphabet, a
runs test of upper and lower half, and a lag-one serial correlation test.  The
three give one p-value under "uniformly random".  Random tokens have uniform
p-values while structured ones crowd at 0, so counts of all tokens by length
class and p-value give the false-discovery rate of each cut; every length class
gets the widest cut that holds the rate.

The texts are searched once (:func:`searched`); cuts and spans come from what was
found.  Patterns and span lists take time in proportion to a text and its matches.

Edge cases: a null text is the empty string, with no spans and the digest of the
empty string.  Rows are judged one by one (repeated rows, repeated ids and extra
columns change nothing); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import apart_from, find_spans, joined, tagged

# The base patterns. Atomic forms of them that find the same matches in linear time.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
TOKEN = r"(?:\G|(?<![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{20,}+={0,2}"
# Alphabets by encoding, in the order in which they are tried.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("hex", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", "^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("upper", "^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Cuts on the p-value that are tried, from wide to narrow.
CUTS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5)


def _alphabet(token: Column) -> Column:
    out = F.lit(ENCODINGS[-1][2])
    for _, pattern, letters in reversed(ENCODINGS[:-1]):
        out = F.when(token.rlike(pattern), F.lit(letters)).otherwise(out)
    return out


def randomness(token: Column) -> Column:
    """The battery's p-value under "uniform over the inferred alphabet"; null for under two characters."""
    body = F.translate(F.rtrim(F.translate(token, "=", " ")), "-_", "+/")

    def battery(x: Column) -> Column:
        n, k, at = F.size(x["at"]).cast("double"), F.length(x["abc"]).cast("double"), x["at"]
        squares = F.aggregate(F.sequence(F.lit(0), F.length(x["abc"]) - 1), F.lit(0.0), lambda acc, a: acc + F.pow(F.size(F.filter(at, lambda i: i == a)).cast("double"), F.lit(2.0)))
        chi, df = squares * k / n - n, k - 1
        z = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        log_chi = -F.log1p(F.exp(F.least(1.5976 * z + 0.070566 * z * z * z, F.lit(600.0))))
        pairs = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        mid, var = (k - 1) / 2, (k * k - 1) / 12
        runs = F.aggregate(pairs, F.lit(0.0), lambda acc, q: acc + F.when((q["a"] > mid) != (q["b"] > mid), 1.0).otherwise(0.0))
        z_runs = (runs - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        serial = F.aggregate(pairs, F.lit(0.0), lambda acc, q: acc + (q["a"] - mid) * (q["b"] - mid)) / var / F.sqrt(n - 1)
        half = (z_runs * z_runs + serial * serial) / 2 - log_chi  # half of Fisher's statistic, 4 degrees of freedom
        return F.when(n >= 2, F.exp(-half) * (1 + half))

    # one-element transforms stand for let-bindings
    first = F.transform(F.array(body), lambda b: F.struct(b.alias("b"), _alphabet(b).alias("abc")))
    second = F.transform(first, lambda x: F.struct(x["abc"].alias("abc"), F.transform(F.split(x["b"], ""), lambda c: F.instr(x["abc"], c) - 1).alias("at")))
    return F.element_at(F.transform(second, battery), 1)


def _class(length: Column) -> Column:
    """Length classes 20, 24, 32, 48, 64, 96, 128 and up."""
    out = F.lit(20)
    for low in (24, 32, 48, 64, 96, 128):
        out = F.when(length >= low, F.lit(low)).otherwise(out)
    return out


def base_spans(text: Column) -> dict[str, Column]:
    """Base spans by kind, as listed."""
    assign = find_spans(text, ASSIGN, (F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))) & text.rlike(r"(?i)passw|secret|token|api_?key"))
    return {
        "assign": F.filter(assign, lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6),
        "access": find_spans(text, ACCESS, F.contains(text, F.lit("AKIA"))),
        "hex": find_spans(text, HEX, text.rlike(r"[0-9a-f]{24}")),
    }


def _tokens(text: Column) -> Column:
    found = find_spans(text, TOKEN, text.rlike(r"[A-Za-z0-9+/_-]{20}"))
    mixed = F.filter(found, lambda x: x["m"].rlike("[A-Za-z]") & (x["m"].rlike("[0-9]") | x["m"].rlike("^[^a-z]*+[a-z][^A-Z]*+[A-Z]")))
    return F.transform(mixed, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _class(F.length(x["m"])).alias("c"), randomness(x["m"]).alias("p")))


def searched(docs: DataFrame) -> DataFrame:
    """doc_id, the arrays of base spans by kind, and ``tokens`` with their length class and p-value, of each row's text."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    place = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))
    return out.select("doc_id", *[F.transform(c, place).alias(k) for k, c in base_spans(F.col("text")).items()], _tokens(F.col("text")).alias("tokens"))


def cuts(found: DataFrame, rate: float = 0.05) -> dict[int, float]:
    """The cut of each length class at false-discovery rate ``rate``, from the counts of all tokens of :func:`searched`.

    Twice the tokens with p >= 0.5 estimates the random ones; what a cut admits beyond them is false.
    """
    step = F.lit(0.0)
    for cut in CUTS:
        step = F.when(F.col("x.p") >= cut, F.lit(cut)).otherwise(step)
    rows = found.select(F.explode("tokens").alias("x")).groupBy(F.col("x.c").alias("c"), step.alias("cut")).count().collect()
    out: dict[int, float] = {}
    for c in {r["c"] for r in rows}:
        above = lambda t: sum(r["count"] for r in rows if r["c"] == c and r["cut"] >= t)  # noqa: E731, B023
        core = 2 * above(0.5)
        for t in CUTS:
            if core and 1 - min(1.0, core * (1 - t) / above(t)) <= rate:
                out[c] = t
                break
    return out


def scan(found: DataFrame, limits: dict[int, float]) -> DataFrame:
    """The columns of :func:`searched` with ``random``, the spans that the battery adds, in place of the tokens."""
    limit = F.lit(2.0)
    ok = lambda x: F.lit(False)
    if limits:

        def ok(x: Column) -> Column:
            cut = limit
            for c, t in limits.items():
                cut = F.when(x["c"] == c, F.lit(t)).otherwise(cut)
            return x["p"] >= cut

    random = apart_from(F.filter("tokens", ok), F.concat("assign", "access", "hex"))
    return found.select("doc_id", "assign", "access", "hex", random.alias("random"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from :func:`scan`'s."""
    base = F.concat(*[tagged(F.col(k), i, k) for i, k in enumerate(("assign", "access", "hex"))])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        base.alias("base"),
        tagged(F.col("random"), 3, "random").alias("more"),
    ).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_random")
    )
