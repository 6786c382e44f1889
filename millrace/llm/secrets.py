"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text (its blob). The ledger says which rule versions have
seen which blob and keeps what each of them found, as kind@version. A scan reads only the blobs for which some rule
version is missing, one text of each however many paths and versions share it, runs only the missing rules, adds to the
ledger, and joins the findings back to all paths. Paths and blobs meet as narrow rows. If a
tenth of the paths or less has unseen blobs, and they are BROADCAST_BLOBS or fewer, they are broadcast to the texts, so that
no text moves; else, as in a first scan, texts are shuffled to them.

Defined results: a null text counts as empty; a null or repeated id is a path like any other and gets its row for each
of its versions; a text without findings has an empty list; empty tables give empty results. Spans count code points,
end exclusive, and are ordered by start, then by the order of the rules. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shared_folder, slices, texts_of, written


@dataclass(frozen=True)
class Rule:
    """Matches of pattern whose group has at least `least` characters. hints: one of them, in lower case, is in any matching text; none: see hex_run."""

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    hints: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: What follows a private key's header: all up to its END line; without one, header fields and the block of base64 (long
#: runs, then lines of nothing else), whose line ends may be escaped.
_TO_END = (
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END (?:[A-Z]+ )?PRIVATE KEY-----"
    r"|(?:\s*+(?:Proc-Type|DEK-Info):[^\n]*+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{20,}+={0,2})*+(?:(?:\r?\n)[A-Za-z0-9+/]++={0,2}(?=\s*(?:\n|\Z)))*+)"
)
#: Fixed patterns of the three base kinds, then the ones that this scan adds.
BASE_RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 16, 0, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]+", 32),
)
RULES = (
    *BASE_RULES,
    Rule("private_key", 2, r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----" + _TO_END, 1, 0, ("private key-----",)),
    Rule("vcs_token", 1, r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})", 1, 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-")),
    Rule("chat_token", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 1, 0, ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("web_token", 1, r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 1, 0, ("eyj",)),
)
#: Unseen blobs, at about 200 bytes each.
BROADCAST_BLOBS = 200_000
#: Spans, and two more for each blob's hash, at about 50 bytes each.
BROADCAST_SPANS = 200_000
SPANS = "array<struct<kind:string,start:int,end:int>>"
_HEX_OR_NOT = bytes(104 if chr(i) in "0123456789abcdef" else 46 for i in range(256))
_HEX_RUN = b"h" * 32


def find_spans(text: bytes, rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """(start, number of the rule, end) of each finding, sorted. Literal hints spare most texts the regular expressions."""
    lowered, found, decoded = text.lower(), [], None
    for k, rule in enumerate(rules):
        if rule.hints:
            if not any(h.encode() in lowered for h in rule.hints):
                continue
        elif _HEX_RUN not in text.translate(_HEX_OR_NOT):
            continue
        decoded = text.decode() if decoded is None else decoded
        for m in re.finditer(rule.pattern, decoded, re.ASCII):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def manifest(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, blob for every version of every path."""
    return versions.select(F.col(id_col).alias("id"), blob_of(F.col(text_col)).alias("blob"))


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def unseen(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, id of one path that has it, missing (numbers of the rules that haven't seen it). Ids and hashes only."""
    blobs = paths.groupBy("blob").agg(F.min("id").alias("id"))
    names = F.array(*[F.lit(r.name) for r in rules])
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    marked = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    missing = F.transform(F.filter(F.arrays_zip(names.alias("n"), F.sequence(F.lit(0), F.lit(len(rules) - 1)).alias("k")), lambda x: ~F.array_contains(F.col("seen"), x["n"])), lambda x: x["k"])
    return marked.select("blob", "id", missing.alias("missing")).filter(F.size("missing") > 0)


def scan_blobs(versions: DataFrame, todo: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str, few: bool) -> DataFrame:
    """blob, rules, spans: ledger rows for the blobs of `todo`. Texts are asked for by blob and id, so copies of one text don't meet. few: `todo` is broadcast.

    Rows with one id (or none) and one text do meet; each task scans the first of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [r.name for r in rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        done: set[str] = set()  # as many as the task has texts, at most
        for batch in batches:
            blobs, first = batch.column("blob").to_pylist(), []
            for row, blob in enumerate(blobs):
                if blob not in done:
                    done.add(blob)
                    first.append(row)
            for part in slices(batch if len(first) == len(blobs) else batch.take(pa.array(first, pa.int64())), "text"):
                used, spans = [], []
                for text, missing in zip(texts_of(part, "text"), part.column("missing").to_pylist(), strict=True):
                    own = tuple(rules[k] for k in missing)
                    used.append([names[k] for k in missing])
                    spans.append([{"kind": own[k].name, "start": a, "end": b} for a, k, b in find_spans(text, own)])
                yield pa.RecordBatch.from_arrays([part.column("blob"), pa.array(used, pa.list_(pa.string())), pa.array(spans, kind)], ["blob", "rules", "spans"])

    texts = versions.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.withColumn("blob", blob_of(F.col("text")))
    wanted = todo.withColumnRenamed("id", "of").withColumnRenamed("blob", "of_blob")
    wanted = F.broadcast(wanted) if few else wanted
    picked = texts.join(wanted, (texts["blob"] == F.col("of_blob")) & texts["id"].eqNullSafe(F.col("of")))
    rows = picked.select("blob", "text", "missing").mapInArrow(run, f"blob string, rules array<string>, spans {SPANS}")
    return rows.dropDuplicates(["blob"])  # a path repeated with the same text


def scan_secrets(versions: DataFrame, ledger_dir: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, blob, spans for every version of every path.

    ledger_dir: a folder of ledger rows (Parquet), made if it isn't there, read first and added to; none: a new ledger in the shared folder.
    """
    spark = versions.sparkSession
    schema = f"blob string, rules array<string>, spans {SPANS}"
    folder = ledger_dir or shared_folder(spark)
    spark.range(0).select(F.lit("").alias("blob"), F.array().cast("array<string>").alias("rules"), F.array().cast(SPANS).alias("spans")).write.mode("ignore").parquet(folder)
    paths = written(manifest(versions, id_col, text_col))
    todo = written(unseen(paths, spark.read.schema(schema).parquet(folder), rules))
    n = todo.count()
    few = n <= BROADCAST_BLOBS and 10 * n <= paths.count()
    scan_blobs(versions, todo, rules, id_col, text_col, few).write.mode("append").parquet(folder)
    names = F.array(*[F.lit(r.name) for r in rules])
    # Blobs without findings needn't be joined.
    found = spark.read.schema(schema).parquet(folder).filter((F.size("spans") > 0) & F.arrays_overlap("rules", names))
    # Older ledgers have the kind alone; its version is the one among the row's rules.
    of_kind = lambda s: F.get(F.filter("rules", lambda r: F.substring_index(r, "@", 1) == s["kind"]), F.lit(0))
    versioned = F.transform(
        "spans",
        lambda s: F.struct(F.when(F.contains(s["kind"], F.lit("@")), s["kind"]).otherwise(of_kind(s)).alias("name"), s["start"].alias("start"), s["end"].alias("end")),
    )
    # Findings of these rule versions only.
    own = F.filter(versioned, lambda s: F.array_contains(names, s["name"]))
    found = found.select("blob", own.alias("spans")).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    ordered = F.transform(
        F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(names, s["name"]).alias("k"), s["end"].alias("end"), s["name"].alias("name")))),
        lambda s: F.struct(F.substring_index(s["name"], "@", 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    joined = paths.join(found.select("blob", ordered.alias("spans")), "blob", "left")
    return joined.select(F.col("id").alias(id_col), "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def redact(docs: DataFrame, findings: DataFrame, text_col: str = "text", mask: str = "[REDACTED]") -> DataFrame:
    """The documents with their found spans masked; overlapping spans are masked as one. findings: blob, spans.

    The blobs with findings are broadcast after their spans have been counted; beyond BROADCAST_SPANS the texts are shuffled to them.
    """
    spans = written(findings.filter(F.size("spans") > 0).dropDuplicates(["blob"]).select(F.struct("blob", "spans").alias("__found")))
    held = spans.agg(F.coalesce(F.sum(F.size("__found.spans") + 2), F.lit(0))).first()[0]
    spans = F.broadcast(spans) if held <= BROADCAST_SPANS else spans

    def masked(text: str, own: list[dict]) -> str:
        parts, at = [], 0
        for span in own:
            if span["start"] >= at:
                parts += [text[at : span["start"]], mask]
            at = max(at, span["end"])
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                found = part.column("__spans").is_valid().to_numpy(zero_copy_only=False)
                texts = part.column(text_col)
                if found.any():
                    texts = pa.array([masked(t, own) if own else t for t, own in zip(texts.to_pylist(), part.column("__spans").to_pylist(), strict=True)], texts.type)
                yield part.drop_columns(["__spans"]).set_column(part.schema.get_field_index(text_col), text_col, texts)

    keyed = docs.withColumn("__blob", blob_of(F.col(f"`{text_col}`")))
    joined = keyed.join(spans, keyed["__blob"] == spans["__found.blob"], "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__found.spans").alias("__spans")).mapInArrow(run, docs.schema)


def digest(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined; of some kinds only, if given."""
    own = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
