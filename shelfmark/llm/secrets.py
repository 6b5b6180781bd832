"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a text is named by its SHA-256. A ledger says which (blob, rule, rule
version) triples have been scanned; a run scans the rest, each distinct blob once however
many paths hold it, and joins findings back to all paths. Only built-in functions are used.

Cases: a null text is scanned as the empty one; rows repeated under one id stay repeated;
an empty table gives empty results; other columns of the input are ignored; a text is scanned
and redacted whole, however long and however many its hits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import whole_text


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds spans; ``value_group`` must hold ``least`` characters, else the span is dropped."""

    kind: str
    version: int
    pattern: str
    value_group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which spans of one start are listed.
BASE_RULES = (
    Rule(
        "assign", 1,
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
RULES = BASE_RULES + (
    # To the footer over nothing but what a key block holds, or where there is none, its lines.
    Rule(
        "pem", 2,
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
        r"(?:[A-Za-z0-9+/=:,\\\x20\x09-\x0D-]*?-----END [A-Z ]{0,40}PRIVATE KEY-----"
        r"|(?:[\\n\x20\x09-\x0D]{0,4}[A-Za-z0-9+/=]{16,}){0,60})",
    ),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
LEDGER = "blob string, rule string"
FINDINGS = "blob string, spans " + SPANS


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _fold(values: Column, step) -> Column:
    """``step`` of all elements up to each, for short arrays: every step copies what there is."""
    first = F.array().cast("array<int>")

    def add(done: Column, value: Column) -> Column:
        last = F.when(F.size(done) == 0, value).otherwise(step(F.try_element_at(done, F.lit(-1)), value))
        return F.concat(done, F.array(last))

    return F.aggregate(values, first, add)


def running(values: Column, step) -> Column:
    """``step`` (associative) of all elements up to each, of an integer array of any length.

    Pieces of about the square root of the length are folded, then their last values; so the
    copying grows with the power 1.5 of the length and not with its square.
    """

    def chunked(values: Column) -> Column:
        n = F.size(values)
        width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), width)
        return _bound(F.transform(starts, lambda at: _fold(F.slice(values, at, width), step)), joined)

    def joined(chunks: Column) -> Column:
        tops = _fold(F.transform(chunks, lambda c: F.try_element_at(c, F.lit(-1))), step)
        return _bound(tops, lambda tops: F.flatten(F.transform(chunks, lambda c, k: raised(c, k, tops))))

    def raised(chunk: Column, k: Column, tops: Column) -> Column:
        return F.when(k == 0, chunk).otherwise(
            _bound(F.get(tops, k - 1), lambda before: F.transform(chunk, lambda v: step(before, v)))
        )

    return _bound(values, chunked)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule in code points: what lies between hits and the hits themselves, laid end to end."""
    none = F.array().cast(SPANS)
    pieces = F.split(text, rule.pattern, -1)

    def laid(hits: Column) -> Column:
        both = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: F.length(p) + F.length(h))
        ends = running(both, lambda a, b: a + b)
        held = F.filter(F.arrays_zip(hits.alias("hit"), ends.alias("end")), long_enough)
        return F.transform(held, span)

    def long_enough(pair: Column) -> Column:
        value = F.regexp_extract(pair["hit"], rule.pattern, rule.value_group) if rule.value_group else pair["hit"]
        return F.length(value) >= rule.least

    def span(pair: Column) -> Column:
        start = pair["end"] - F.length(pair["hit"])
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), pair["end"].alias("end"))

    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    return F.when(text.rlike(rule.pattern), _bound(hits, laid).cast(SPANS)).otherwise(none)


def address(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob) of every version: which paths hold which content."""
    return versions.select(F.col(id_col).alias("path"), F.sha2(whole_text(text_col), 256).alias("blob"))


def pending(paths: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, path, todo): blobs with rules not yet scanned, and one path to read each from."""
    keys = F.array(*(F.lit(r.key) for r in rules))
    blobs = paths.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        return blobs.withColumn("todo", keys)
    seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = F.array_except(keys, F.coalesce(F.col("seen"), F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "path", todo.alias("todo")).filter(F.size("todo") > 0)


def scan_blobs(
    versions: DataFrame, todo: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(blob, todo, spans) of each pending blob, its text read from the path chosen for it."""
    text = F.col("_text")
    # The text meets its plan by path and content, so paths that changed cannot be mixed up.
    held = versions.select(F.col(id_col).alias("_path"), whole_text(text_col).alias("_text"))
    plan = todo.select(F.col("path").alias("_path"), "blob", "todo")
    same = held["_path"].eqNullSafe(plan["_path"])
    found = [
        F.when(F.array_contains("todo", r.key), _spans(text, r, n)).otherwise(F.array().cast(SPANS))
        for n, r in enumerate(rules)
    ]
    spans = F.array_sort(reduce(lambda a, b: F.concat(a, b), found))
    rows = held.join(plan, same, "inner").filter(F.sha2(text, 256) == F.col("blob"))
    return rows.select("blob", "todo", spans.alias("spans")).groupBy("blob").agg(
        F.first("todo").alias("todo"), F.first("spans").alias("spans")
    )


def scan(
    versions: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    ledger: DataFrame | None = None,
    findings: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One increment: (ledger, findings, by_path) after scanning what the ledger lacks.

    ``findings`` are those of earlier runs; ``by_path`` has a row (path, blob, spans) for each
    row of ``versions``. The scan itself is written once to the shared folder.
    """
    paths = address(versions, id_col, text_col)
    fresh = cut_lineage(scan_blobs(versions, pending(paths, ledger, rules), rules, id_col, text_col))
    new_ledger = fresh.select("blob", F.explode("todo").alias("rule"))
    new_findings = fresh.select("blob", "spans")
    if ledger is not None:
        new_ledger = ledger.select("blob", "rule").unionByName(new_ledger)
    if findings is not None:
        both = findings.select("blob", "spans").unionByName(new_findings)
        merged = F.array_sort(F.flatten(F.collect_list("spans")))
        new_findings = both.groupBy("blob").agg(merged.alias("spans"))
    # A blob held by very many paths is a hot key here: one small row meets them, and the
    # join's large side can be split by AQE.
    by_path = paths.join(new_findings, "blob", "left").select("path", "blob", "spans")
    return new_ledger, new_findings, by_path


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mark``.

    ``spans`` are in order of their starts. Cuts are taken from stretches of about the square
    root of their number, since finding a place in a text means walking up to it.
    """
    cut = lambda t, at, to: F.substring(t, at + 1, to - at)

    def opened(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda s: s["end"]), F.greatest)
        return _bound(reach, lambda reach: kept(spans, reach))

    def kept(spans: Column, reach: Column) -> Column:
        # A kept stretch runs from where all spans so far end to the next start at or behind it.
        gaps = F.transform(
            spans, lambda s, n: F.struct(F.when(n > 0, F.get(reach, n - 1)).otherwise(0).alias("at"), s["start"].alias("to"))
        )
        tail = F.struct(F.try_element_at(reach, F.lit(-1)).alias("at"), F.lit(2**31 - 1).alias("to"))
        return _bound(F.concat(F.filter(gaps, lambda g: g["to"] >= g["at"]), F.array(tail)), stretches)

    def stretches(gaps: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(gaps))).cast("int")
        groups = F.transform(F.sequence(F.lit(1), F.size(gaps), width), lambda at: F.slice(gaps, at, width))
        return F.array_join(F.flatten(F.transform(groups, pieces)), mark)

    def pieces(group: Column) -> Column:
        first, last = F.get(group, 0)["at"], F.try_element_at(group, F.lit(-1))["to"]
        here = F.struct(cut(text, first, last).alias("text"), first.alias("at"))
        return _bound(here, lambda h: F.transform(group, lambda g: cut(h["text"], g["at"] - h["at"], g["to"] - h["at"])))

    return F.when(F.size(spans) > 0, _bound(spans, opened)).otherwise(text)


def redacted(versions: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``versions`` with every secret blotted out, and ``n_chars``, if there is one, brought up to date.

    Findings meet texts by content, so every copy of a blob is treated alike.
    """
    _, findings, _ = scan(versions, rules, id_col=id_col, text_col=text_col)
    hit = findings.filter(F.size("spans") > 0).select(F.col("blob").alias("_hit_blob"), F.col("spans").alias("_hit_spans"))
    met = versions.join(hit, F.sha2(whole_text(text_col), 256) == F.col("_hit_blob"), "left")
    found = F.col("_hit_spans").isNotNull()
    # The new text gets a name of its own first: a select would take it for the old one inside lambdas.
    met = met.withColumn("_hit_text", F.when(found, redact(F.col(text_col), F.col("_hit_spans"))).otherwise(F.col(text_col)))
    out = {text_col: F.col("_hit_text")}
    if "n_chars" in versions.columns:
        length = F.length("_hit_text").cast(versions.schema["n_chars"].dataType)
        out["n_chars"] = F.when(found, length).otherwise(F.col("n_chars"))
    return met.select(*(out[c].alias(c) if c in out else F.col(c) for c in versions.columns))
