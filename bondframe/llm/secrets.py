"""Secret scan: base patterns, and weak candidates linked by co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import docs_only

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: A run this long of these characters may be an identifier or a secret.
PART = r"[A-Za-z0-9+/]{16,}"
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]+"""
#: Kinds in the order in which spans that start together are listed.
KINDS = ["assign", "access", "hex", "ident", "secret", "endpoint"]
#: Code points between the starts of two parts up to which each lies in the other's scope.
SCOPE = 512
SPAN = "array<struct<start:int,kind:int,stop:int>>"


def _none() -> Column:
    return F.array().cast(SPAN)


def find_spans(text: Column, pattern: str, kind: int, least: int, group: int = 0, gate: str = "") -> Column:
    """Spans of the leftmost non-overlapping matches, in code points.

    The gaps that split() leaves and the matches alternate, so running sums
    of their lengths are the spans. Matches whose ``group`` is shorter than
    ``least`` are dropped after matching. ``gate`` is a pattern that every
    text with a kept match contains: others are spared the work.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), held, lambda g, h: F.struct(F.length(g["gap"]).alias("gap"), F.length(g["hit"]).alias("hit"), F.length(h).alias("held")))
    start = F.struct(F.lit(0).alias("at"), _none().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        stop = at + F.coalesce(x["hit"], F.lit(0))
        one = F.array(F.struct(at.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(x["held"] >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(steps, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(gate or pattern), spans).otherwise(_none())


def _near(spans: Column, others: Column) -> Column:
    """Those spans in whose scope one of ``others`` starts."""
    return F.filter(spans, lambda s: F.exists(others, lambda o: F.abs(o["start"] - s["start"]) <= SCOPE))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of every row; both arrays of (start, kind, stop).

    base: the spans of the three base patterns. spans: base ones and the
    weak candidates that are linked. Weak candidates are identifiers (runs
    of 16 to 32 of A-Z0-9 with a letter and a digit), secrets (runs of 20 to
    128 of [A-Za-z0-9+/] with upper case, lower case and digit) and endpoints
    (http and https urls). Base access spans are identifiers too, base
    assign and hex spans secrets. A weak identifier counts only with a
    secret in its scope, a weak secret only with an identifier, an endpoint
    only with both. The scope of a part is the interval of SCOPE code points
    to either side of its start. The interval join of the parts runs inside
    each row, so there is no shuffle and no key that could be hot; its work
    is the product of a row's identifiers and secrets.

    Null text counts as empty; rows without a span return empty arrays;
    repeated rows stay.
    """
    d = docs_only(docs, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    t = F.col("text")
    d = d.select(
        "doc_id",
        "text",
        find_spans(t, ASSIGN, 0, 12, 2).alias("assign"),
        F.when(F.contains(t, F.lit("AKIA")), find_spans(t, ACCESS, 1, 18)).otherwise(_none()).alias("access"),
        find_spans(t, HEX, 2, 16, gate=HEX[:-1] + "{16}").alias("hex"),
    )
    # weak parts are only looked for where both roles can be present
    some = ((F.size("access") > 0) | t.rlike("[A-Z0-9]{16}")) & ((F.size("assign") > 0) | (F.size("hex") > 0) | t.rlike("[A-Za-z0-9+/]{20}"))
    part = F.when(some, F.array_compact(F.transform(find_spans(t, PART, 3, 16), lambda s: _weak(t, s)))).otherwise(_none())
    d = d.withColumn("part", part)
    d = d.withColumn("ident", F.filter("part", lambda s: s["kind"] == 3)).withColumn("secret", F.filter("part", lambda s: s["kind"] == 4))
    d = d.withColumn("idents", F.concat("access", "ident")).withColumn("secrets", F.concat("assign", "hex", "secret"))
    both = (F.size("idents") > 0) & (F.size("secrets") > 0)
    ends = F.when(both & F.contains(t, F.lit("://")), find_spans(t, ENDPOINT, 5, 1)).otherwise(_none())
    d = d.withColumn("endpoint", ends)
    i, s = F.col("idents"), F.col("secrets")
    weak = F.when(both, F.concat(_near(F.col("ident"), s), _near(F.col("secret"), i), _near(_near(F.col("endpoint"), s), i))).otherwise(_none())
    base = F.concat("assign", "access", "hex")
    return d.select("doc_id", F.array_sort(base).alias("base"), F.array_sort(F.concat(base, weak)).alias("spans"))


def _weak(text: Column, s: Column) -> Column:
    """The span as identifier or secret, else null."""
    run = F.substr(text, s["start"] + 1, s["stop"] - s["start"])
    n = s["stop"] - s["start"]
    digit = run.rlike("[0-9]")
    ident = (n <= 32) & digit & run.rlike("^[A-Z0-9]*[A-Z][A-Z0-9]*$")
    secret = (n >= 20) & (n <= 128) & digit & run.rlike("[A-Z]") & run.rlike("[a-z]")
    as_kind = lambda k: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["stop"].alias("stop"))
    return F.when(ident, as_kind(3)).when(secret, as_kind(4))


def listed(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")
