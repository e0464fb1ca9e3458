"""Secret scans with an incremental ledger of content-addressed blobs.

Every historical version of a path is a row with a text.  A text is addressed by its SHA-256;
the ledger holds one row per blob and scan with the rule versions that were run on it and what
they found.  A scan runs only the rule versions a blob has not seen, once per blob however
many paths share it, and findings are joined back to all paths.

Defined cases: a null text is the empty blob; a null path is carried through; repeated rows
give repeated results; an empty ledger means that nothing was scanned; other columns are
ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import flat_spans, map_slices, packed, sha256_hex, unpacked


@dataclass(frozen=True)
class Rule:
    """One pattern under a version; a change of either is a new rule version.

    A match must have at least ``least`` characters in ``group``.
    """

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    flags: int = re.ASCII

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: A private key through its END line, or without one through its headers and base64 lines (line ends may be escaped).
_PEM = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?:(?:\s|\\[nr])+(?:Proc-Type|DEK-Info):[^\n\\]*)*(?:(?:(?:\s|\\[nr])+[A-Za-z0-9+/]{40,}={0,2})+(?:(?:\r?\n|\\n)[A-Za-z0-9+/]+={0,2}(?![^\s\\\"']))?)?)"
)
#: The first three are the base rules; the order breaks ties between spans.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, re.ASCII | re.IGNORECASE),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 16),
    # As long as it is greedy, {32,} takes the same runs as + and a check of the length.
    Rule("hex", 1, r"[0-9a-f]{32,}", 32),
    Rule("pem", 2, _PEM, 1),
    Rule("pat", 1, r"gh[opsu]_[A-Za-z0-9]+", 40),
    # Only at the start of a run of its characters: each run is read once.
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 30),
)
BASE = tuple(r.kind for r in RULES[:3])
MARK = "[SECRET]"
LEDGER = "blob string, rules array<string>, spans array<struct<rule: string, start: int, stop: int>>"


def find(text: str, rules: tuple[Rule, ...], compiled: dict[str, re.Pattern]) -> list[tuple[str, int, int]]:
    return [
        (rule.name, m.start(), m.end())
        for rule in rules
        for m in compiled[rule.name].finditer(text)
        if len(m.group(rule.group)) >= rule.least
    ]


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for the blobs of ``versions(path, text)`` and rule versions not in ``ledger``."""
    names = [r.name for r in rules]
    blobs = versions.select(
        F.col("path").alias("_path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"), "text"
    )
    # One row per blob stands for all: the smallest path that holds it (nulls last).
    chosen = blobs.groupBy("blob").agg(F.min("_path").alias("_chosen"))
    if ledger is None:
        pending = chosen.withColumn("rules", F.array(*map(F.lit, names)))
    else:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).distinct()
        seen = seen.groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # bounded by the rule versions
        pending = (
            chosen.join(seen, "blob", "left")
            .withColumn("rules", F.array_except(F.array(*map(F.lit, names)), F.coalesce("seen", F.array().cast("array<string>"))))
            .where(F.size("rules") > 0)
            .drop("seen")
        )
    # A path can hold a blob twice; the first of equal texts is as good as any.
    carried = packed(blobs.select("_path", "blob", "text"), "_path", "blob")
    work = (
        carried.alias("c")
        .join(
            pending.alias("p"),
            (F.col("c.blob") == F.col("p.blob")) & F.col("c._path").eqNullSafe(F.col("p._chosen")),
        )
        .select("c.blob", "p.rules", "c.packed")
    )

    def make():
        known = {r.name: r for r in rules}
        compiled = {r.name: re.compile(r.pattern, r.flags) for r in rules}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans = []
            for wanted, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = unpacked(blob).decode()
                found = find(text, tuple(known[n] for n in wanted), compiled)
                spans.append([{"rule": n, "start": s, "stop": e} for n, s, e in found])
            kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, kind)], names=["blob", "rules", "spans"]
            )

        return each

    return map_slices(work, make, LEDGER)


def join_findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``path``, ``blob`` and the spans that the current rule versions have on its blob."""
    names = [r.name for r in rules]
    # Rows of one blob are few (one a scan), and a rule version occurs in one of them; if a
    # blob was written twice in one scan its rows are equal.
    found = (
        ledger.select("blob", F.explode_outer("spans").alias("s"))
        .where(F.col("s.rule").isin(names))
        .groupBy("blob")
        .agg(F.collect_set("s").alias("spans"))
    )
    paths = versions.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    return paths.join(found, "blob", "left").select("path", "blob", "spans")


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings per row of ``docs`` and the ledger that now also covers them."""
    versions = docs.select(F.col("doc_id").alias("path"), "text")
    fresh = cut(scan_unseen(versions, ledger), "secret-ledger")
    whole = fresh if ledger is None else ledger.select("blob", "rules", "spans").unionByName(fresh)
    return join_findings(versions, whole), whole


def digest(findings: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, ``base_sha256`` and ``spans`` for every row."""

    def make():
        rank = {r.name: (i, r.kind) for i, r in enumerate(RULES)}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: dict[str, list[int]] = {kind: [] for kind in BASE}
            digests, joined = [], []
            for found in batch.column(1).to_pylist():
                spans = [(s["start"], *rank[s["rule"]], s["stop"]) for s in found or []]
                base = [s for s in spans if s[2] in BASE]
                for kind in BASE:
                    counts[kind].append(sum(s[2] == kind for s in base))
                digests.append(sha256_hex(flat_spans(base).encode()))
                joined.append(flat_spans(spans))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests), pa.array(joined)],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

        return each

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return map_slices(findings.select(F.col("path").alias("doc_id"), "spans"), make, schema, 4096)


def redact(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; in ``text`` every secret reads ``[SECRET]``, ``n_chars`` follows.

    Overlapping spans become one mark.  All rows stay; untouched texts stay as they are.
    """
    findings, _ = scan_documents(docs)
    spans = "_spans"
    while spans in {c.lower() for c in docs.columns}:
        spans += "_"

    @F.udf("array<struct<start: int, stop: int>>")
    def merged(spans):  # only runs on blobs with findings; the last span comes first
        out: list[list[int]] = []
        for start, stop in sorted((s["start"], s["stop"]) for s in spans):
            if out and start < out[-1][1]:
                out[-1][1] = max(out[-1][1], stop)
            else:
                out.append([start, stop])
        return [tuple(x) for x in reversed(out)]

    marked = (
        findings.where(F.size("spans") > 0)
        .groupBy(F.col("blob").alias("_blob"))
        .agg(F.first("spans").alias("_found"))
        .select("_blob", merged("_found").alias("_spans"))
    )
    blanked = F.aggregate(
        spans,
        F.col("text"),
        lambda text, s: F.concat(
            F.substring(text, F.lit(1), s["start"]), F.lit(MARK), F.substring(text, s["stop"] + 1, F.length(text))
        ),
    )
    blob = F.sha2(F.col("d.text"), 256) == F.col("m._blob")
    joined = docs.alias("d").join(marked.alias("m"), blob, "left").select("d.*", F.col("m._spans").alias(spans))
    found = F.col(spans).isNotNull() & F.col("text").isNotNull()
    changes = {"text": F.when(found, blanked).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(found, F.length(blanked).cast("long")).otherwise(F.col("n_chars"))
    return joined.withColumns(changes).select(*docs.columns)
