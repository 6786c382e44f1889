import pytest
from pyspark.sql import functions as F

from millrace.functions import answers as N
from millrace.functions import paths as P
from millrace.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) and not isinstance(v, bool) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize(("raw", "lines"), [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("line one\r\nline two\r\nline three\r\n", ["line one", "line two", "line three"]), ("a\rb\r", ["a", "b"]), ("a\rb\n", ["a\rb"]), ("﻿x\ny", ["x", "y"]), ("x﻿", ["x﻿"]), ("\n", [""]), (None, None)])
def test_lines(spark, raw, lines):
    assert one(spark, T.to_lines(F.col("t")), t=raw) == lines


@pytest.mark.parametrize(("text", "parts"), [("XMLHttpRequest", "XML Http Request"), ("userID", "user ID"), ("RATE_LIMIT_MS", "RATE LIMIT MS"), ("getUser2ById", "get User 2 By Id"), ("", "")])
def test_split_identifiers(spark, text, parts):
    assert one(spark, T.split_identifiers(F.col("t")), t=text) == parts


def test_search_text_and_tokens(spark):
    assert one(spark, T.search_text(F.col("t")), t="const RATE_LIMIT_MS = 1000;") == "const RATE_LIMIT_MS = 1000;\nconst RATE LIMIT MS 1000"
    assert one(spark, T.identifier_tokens(F.col("t")), t="What calls service.method(?") == ["service.method("]
    assert one(spark, T.identifier_tokens(F.col("t")), t="where is getUserById and MAX_SIZE, getUserById") == ["getUserById", "MAX_SIZE"]
    assert one(spark, T.lexemes(F.col("t")), t="Größe, x_y 12!") == ["größe", "x", "y", "12"]


def test_text_functions(spark):
    assert one(spark, T.embedding_text(F.lit("a.ts"), F.lit(None).cast("string"), F.lit(1), F.lit(9), F.col("t")), t="c") == "// a.ts lines 1-9\nc"
    assert one(spark, T.embedding_text(F.lit("a.ts"), F.lit("f"), F.lit(1), F.lit(9), F.col("t")), t="c") == "// a.ts (f) lines 1-9\nc"
    assert len(one(spark, T.model_input(F.col("t")), t="x" * 9000)) == 4500
    assert one(spark, T.redact(F.col("t")), t="a ghp_" + "A" * 36 + " b github_pat_" + "x" * 22) == "a [REDACTED] b [REDACTED]"
    assert one(spark, T.stored_title(F.col("t")), t="a\0b" + "c" * 99) == "ab" + "c" * 78
    assert one(spark, T.first_paragraph(F.col("t")), t="# Title\n\n## Sub\n\nFirst  real\nparagraph.\n\nNext") == "First real paragraph."
    assert one(spark, T.first_paragraph(F.col("t")), t="# Title\n") is None
    assert one(spark, T.first_paragraph(F.col("t")), t="x" * 600) == "x" * 500 + "…"
    assert [one(spark, T.minified(F.col("t")), t=x) for x in ("a" * 2000, "b\n" + "a" * 2001)] == [False, True]
    lines = [f"l{i}" for i in range(1, 6)]
    assert [one(spark, T.read_range(F.col("l"), F.lit(a), F.lit(b)), l=lines) for a, b in ((2, 3), (0, 1), (4, 99), (6, 7), (3, 2))] == ["l2\nl3", "l1", "l4\nl5", None, ""]
    assert one(spark, T.estimate_tokens(F.lit(9), 100), t="") == 103 and one(spark, T.fits_budget(F.lit(40), 100, 100), t="")


@pytest.mark.parametrize(("path", "kind", "lang"), [("a/b.TS", "allowed", "ts"), ("Makefile", "unknown", None), ("a.b/c", "unknown", None), ("x.exe", "denied", "exe"), (".gitignore", "denied", None), ("a/.env", "denied", None)])
def test_extensions(spark, path, kind, lang):
    assert one(spark, P.classify_extension(F.col("p")), p=path) == kind and one(spark, P.lang_from_path(F.col("p")), p=path) == lang


def test_path_filters(spark):
    assert [one(spark, P.denylisted(F.col("p")), p=x) for x in ("node_modules/a", "a/dist/b.ts", "distx/a", "a/out")] == [True, True, False, False]
    assert [one(spark, P.filename_denied(F.col("p")), p=x) for x in ("a/yarn.lock", "x.min.js", "y.map", "z.generated.ts", "map.ts")] == [True, True, True, True, False]
    reason = lambda p, size=1, ignored=False, binary=False, mini=False: one(spark, P.skip_reason(F.lit(p), F.lit(size), F.lit(ignored), F.lit(binary), F.lit(mini)), t="")
    assert [reason("a.exe", ignored=True), reason("yarn.lock"), reason("a.exe", 999_999), reason("a.ts", 262_145), reason("a.ts", 262_144), reason("a.ts", 1, False, True, True), reason("a.ts", mini=True)] == ["gitignored", "filename", "extension", "too_large", None, "binary", "minified"]
    assert [one(spark, P.safe_relative_path(F.col("p")), p=x) for x in ("a/b", "a/../b", "../a", "a/../../b", "/a", "C:\\a", "..\\a", "\\\\host\\a", "a\\..\\b", "")] == [True, True, False, False, False, False, False, False, True, False]
    assert [one(spark, P.two_segment_dir(F.col("p")), p=x) for x in ("a.ts", "src/a.ts", "src/x/a.ts", "src/x/y/a.ts")] == [None, "src", "src/x", "src/x"]
    assert [one(spark, P.valid_source_ref(F.lit(u), F.lit(b)), t="") for u, b in (("https://GitHub.com/a/b", None), ("https://github.com/a/b.git", "main"), ("http://github.com/a/b", None), ("https://github.com/a", None), ("https://github.com/a/b", "-x"), ("https://github.com/a/b", "a..b"))] == [True, True, False, False, False, False]


@pytest.mark.parametrize(("glob", "yes", "no"), [("**/*.ts", ["a.ts", "x/y/a.ts"], ["a.js"]), ("src/*.ts", ["src/a.ts"], ["src/x/a.ts"]), ("a?.md", ["ab.md"], ["a/.md", "abc.md"]), ("src/**", ["src/a", "src/b/c"], ["srcx/a"]), ("a.b", ["a.b"], ["axb"])])
def test_globs(spark, glob, yes, no):
    rows = spark.createDataFrame([(p,) for p in yes + no], "p string")
    assert sorted(r.p for r in rows.filter(P.matches_glob(F.col("p"), glob)).collect()) == sorted(yes)


def test_modes(spark):
    assert [one(spark, P.classify_mode(F.col("q")), q=x) for x in ("What would BREAK if", "trace it", "what is this", "how does data flow", "flower", "is it unused?")] == ["thorough", "thorough", "fast", "thorough", "fast", "thorough"]


def test_citations(spark):
    parse = lambda t, n=5: one(spark, N.parse_citations(F.col("t"), F.lit(n)), t=t)
    assert parse("a [2] b [1][2] c [3, 9,4] 【5】 【1†L9】 [0] [x]") == [2, 1, 3, 4, 5]
    assert parse("[0000000012] [00] [12345678901] [3, 0004]", 12) == [12, 3, 4]
    assert parse("```\narr[1]\n``` then [2]") == [2] and parse("none") == [] and parse("[1]", 0) == []
    df = spark.createDataFrame([("see [1], [2, 3] ```x[1]``` 【1†x】",)], "t string")
    assert df.select(N.render_markers(F.col("t"), F.create_map(F.lit(1), F.lit("u1"), F.lit(3), F.lit("u3")))).first()[0] == "see [1](u1), [2] [3](u3) ```x[1]``` [1](u1)"
    link = lambda kind, rev, ref="https://github.com/a/b.git": one(spark, N.citation_link(F.lit(kind), F.lit(ref), F.lit(rev).cast("string"), F.lit("p.ts"), F.lit(1), F.lit(2)), t="")
    assert [link("git_url", "r"), link("zip_upload", "r"), link("git_private", None), link("git_url", "r", "https://github.com/a/b/")] == ["https://github.com/a/b/blob/r/p.ts#L1-L2", None, None, "https://github.com/a/b/blob/r/p.ts#L1-L2"]
    assert one(spark, N.truncate_answer(F.col("t"), 5), t="abc[12]") == "abc…" and one(spark, N.truncate_answer(F.col("t"), 7), t="abc[12]") == "abc[12]"


def test_verdicts_and_sections(spark):
    good = '{"grounded": true, "allClaimsCited": false, "handledUnknownCorrectly": true, "reasoning": "r"}'
    parse = lambda t: one(spark, N.parse_verdict(F.col("t")), t=t)
    assert parse(good).allClaimsCited is False and parse(f"```json\n{good}\n```").grounded is True
    assert [parse(x) for x in ("x", good.replace("true", '"true"'), good.replace('"r"', "1"), good.replace(', "reasoning": "r"', ""))] == [None] * 4
    text = "intro\n## What this project is\nA b.\n\n## Other\nx\n## How it is organized\n\n## Where to start reading\nc\nd"
    assert [(s.title, s.body) for s in one(spark, N.parse_sections(F.col("t")), t=text)] == [("What this project is", "A b."), ("Where to start reading", "c\nd")]
    kinds = [(429, "", "rate_limited"), (None, "RESOURCE_EXHAUSTED", "rate_limited"), (503, "", "unavailable"), (None, "maximum context hit", "too_large"), (403, "", "auth"), (None, "429 quota", "rate_limited"), (None, "row 429", None), (None, None, None)]
    df = spark.createDataFrame(kinds, "s int, m string, k string").select("k", N.classify_provider_error(F.col("s"), F.col("m")).alias("g"))
    assert all(r.k == r.g for r in df.collect())
    assert [tuple(one(spark, N.split_provider_id(F.col("t")), t=x)) for x in ("groq:a:b", "gemini")] == [("groq", "a:b"), ("gemini", None)]
    ev = F.array(*[F.struct(F.lit(n).alias("marker"), F.lit(p).alias("path"), F.lit(1).alias("start"), F.lit(2).alias("end"), F.lit("c").alias("content"), F.lit(n != 2).alias("used")) for n, p in ((2, "b"), (1, "a"))])
    assert one(spark, N.evidence_block(ev), t="") == "[2] b:1-2\nc\n\n[1] a:1-2\nc" and one(spark, N.sources_line(ev), t="") == "[1] a:1-2"
    assert one(spark, N.assemble_prompt(F.lit("a"), F.lit(None).cast("string"), F.lit(""), F.lit("b")), t="") == "a\n\nb"
