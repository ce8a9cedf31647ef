import random

import pytest

from tallyward.operators import chunks

HANDBOOK = """# Title

lead in

## First part

a
### not a new part
b

##Not either
## Second  
c
"""


def sections(spark, text):
    df = spark.createDataFrame([(1, text)], "doc int, text string")
    got = chunks.markdown_sections(df, "doc").orderBy("section_no").collect()
    return [(r.section, r.text) for r in got]


def test_markdown_sections(spark):
    assert sections(spark, HANDBOOK) == [
        ("First part", "## First part\n\na\n### not a new part\nb\n\n##Not either"),
        ("Second", "## Second  \nc"),
    ]


@pytest.mark.parametrize(
    "text,want",
    [
        ("no heading\nat all\n", [(None, "no heading\nat all")]),
        ("", [(None, "")]),
        ("## A", [("A", "## A")]),
        ("x\r\n## A\r\ny\x0c## B z", [("A", "## A\ny"), ("B", "## B"), ][:1] + [("B z", "## B z")]),
        ("## A\n## B\n", [("A", "## A"), ("B", "## B")]),
        ("## ", [("", "##")]),
        (" ## A\nx", [(None, "## A\nx")]),
    ],
)
def test_markdown_corners(spark, text, want):
    assert sections(spark, text) == want


def numbered(spark, pages):
    df = spark.createDataFrame([(1, n, t) for n, t in pages], "doc int, page bigint, text string")
    got = chunks.numbered_page_sections(df, "doc", "page").orderBy("section_no").collect()
    return [(r.section, r.text, r.page) for r in got]


def test_numbered_sections_cross_pages(spark):
    pages = [
        (1, "Policy\nfrom now on\n1. Scope\nall"),
        (2, "more scope\n"),
        (3, "still\n2. Next\n 3.1 Sub\nend"),
        (4, ""),
        (5, "tail"),
    ]
    assert numbered(spark, pages) == [
        ("Policy", "Policy\nfrom now on", 1),
        ("1. Scope", "1. Scope\nall\nmore scope\nstill", 1),
        ("2. Next", "2. Next", 3),
        (" 3.1 Sub", "3.1 Sub\nend\ntail", 3),
    ]


def test_document_that_opens_with_a_heading_has_an_empty_first_section(spark):
    assert numbered(spark, [(1, "1. A\nx"), (2, "2. B")]) == [
        ("1. A", "", 1),
        ("1. A", "1. A\nx", 1),
        ("2. B", "2. B", 2),
    ]
    df = spark.createDataFrame([(1, 1, "1. A\nx")], "doc int, page bigint, text string")
    flags = chunks.numbered_page_sections(df, "doc", "page").orderBy("section_no").collect()
    assert [f.is_empty for f in flags] == [True, False]


def lines_of(pages):
    return [(page, line) for page, text in pages for line in text.splitlines()]


def expected_sections(pages, opens, keep_lead):
    """Section texts and start pages, line by line."""
    found = [[pages[0][0], []]]
    for page, line in lines_of(pages):
        if opens(line):
            found.append([page, []])
        found[-1][1].append(line)
    if not keep_lead and len(found) > 1:
        found = found[1:]
    return [(page, "\n".join(lines).strip()) for page, lines in found]


def random_pages(seed, count):
    dice = random.Random(seed)
    choices = ["word", "", "## Head {}", "{}. Item", "  {}.{} sub", "### deep", "x\r", "  pad  "]
    return [
        (n, "\n".join(dice.choice(choices).format(n, n) for _ in range(dice.randint(0, 6))))
        for n in range(1, count + 1)
    ]


def test_paged_splits_match_line_by_line_reading(spark, monkeypatch):
    # Short spans make every document reach over many of them.
    monkeypatch.setattr(chunks, "running_before", _short_spans(chunks.running_before))
    docs = {d: random_pages(d, 3 + 9 * (d % 5)) for d in range(25)}
    rows = [(d, n, t) for d, pages in docs.items() for n, t in pages]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc int, page bigint, text string").repartition(5)
    numbered_rows = chunks.numbered_page_sections(df, "doc", "page").collect()
    markdown_rows = chunks.markdown_page_sections(df, "doc", "page").collect()
    for d, pages in docs.items():
        opens = lambda line: line.strip().split(".")[0].isdigit() and "." in line
        got = sorted((r.section_no, r.page, r.text) for r in numbered_rows if r.doc == d)
        assert [g[1:] for g in got] == expected_sections(pages, opens, True)
        got = sorted((r.section_no, r.text) for r in markdown_rows if r.doc == d)
        want = expected_sections(pages, lambda line: line.startswith("## "), False)
        assert [g[1] for g in got] == [w[1] for w in want]


def _short_spans(running_before):
    return lambda *args, **kwargs: running_before(*args, **{**kwargs, "span": 4})


def test_paged_markdown_equals_whole_markdown(spark):
    text = HANDBOOK * 3
    whole = spark.createDataFrame([(1, text)], "doc int, text string")
    lines = text.split("\n")
    pages = spark.createDataFrame(
        [(1, n, line) for n, line in enumerate(lines)], "doc int, page bigint, text string"
    )
    want = [tuple(r) for r in chunks.markdown_sections(whole, "doc").orderBy("section_no").collect()]
    got = chunks.markdown_page_sections(pages, "doc", "page").orderBy("section_no").collect()
    # Pages without text carry no line, so blank lines between pages are lost.
    assert [(g.section_no, g.section) for g in got] == [(w[1], w[2]) for w in want]


@pytest.mark.parametrize("text", ["", "short", "x" * 500, "y" * 501, "é😀" * 700, "a\n" * 800, " " * 600])
def test_fixed_chunks(spark, text):
    df = spark.createDataFrame([(1, text)], "doc int, text string")
    got = chunks.fixed_chunks(df, "doc").orderBy("chunk_no").collect()
    want = [text[i : i + 500].strip() for i in range(0, len(text), 500)]
    assert [r.text for r in got] == want
    assert [r.section for r in got] == [f"chunk_{n}" for n in range(len(want))]


def test_chunk_lengths_add_up(spark, tables):
    documents = spark.read.parquet(f"{tables}/documents.parquet")
    pieces = documents.select(chunks._windows(documents.text, 500).alias("p"))
    total = pieces.selectExpr("sum(aggregate(p, 0, (a, x) -> a + length(x)))").first()[0]
    assert total == documents.selectExpr("sum(length(text))").first()[0]


def test_page_chunks_number_through_the_document(spark, monkeypatch):
    monkeypatch.setattr(chunks, "running_before", _short_spans(chunks.running_before))
    pages = [(n, "z" * (137 * n % 1300)) for n in range(1, 30)]
    rows = [(d, n, t) for d in (1, 2) for n, t in pages]
    df = spark.createDataFrame(rows, "doc int, page bigint, text string").repartition(4)
    got = chunks.fixed_page_chunks(df, "doc", "page").where("doc = 2").orderBy("chunk_no").collect()
    want = [(n, t[i : i + 500]) for n, t in pages for i in range(0, len(t), 500)]
    assert [(r.page, r.text) for r in got] == want
    assert [r.chunk_no for r in got] == list(range(len(want)))


def test_corpus(spark):
    df = spark.createDataFrame([(1, "## A\nx\n## B\ny")], "doc int, text string")
    pages = spark.createDataFrame([(1, 1, "1. C\nz")], "doc int, page bigint, text string")
    whole = chunks.corpus(
        chunks.markdown_sections(df, "doc"), chunks.numbered_page_sections(pages, "doc", "page"), "doc"
    )
    got = {r.chunk_id: (r.source_type, r.section, r.page) for r in whole.collect()}
    assert got == {
        "markdown-1-1": ("markdown", "A", None),
        "markdown-1-2": ("markdown", "B", None),
        "paged-1-0": ("paged", "1. C", 1),
        "paged-1-1": ("paged", "1. C", 1),
    }


def _text_exchanges(df, names):
    """Exchanges of the plan before it runs that carry one of the columns."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    found = 0
    for at, line in enumerate(lines):
        if "Exchange" in line and "Reused" not in line:
            below = lines[at + 1] if at + 1 < len(lines) else ""
            found += any(f"{n}#" in below for n in names)
    return found


@pytest.mark.parametrize("split", ["markdown", "numbered", "fixed"])
def test_page_text_is_numbered_in_one_exchange(spark, split):
    pages = spark.range(50).selectExpr("id % 3 as doc", "id as page", "'1. a' as text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        if split == "fixed":
            df = chunks.fixed_page_chunks(pages, "doc", "page")
            assert _text_exchanges(df, ["text"]) <= 1
        else:
            cut = chunks.markdown_page_sections if split == "markdown" else chunks.numbered_page_sections
            # By span, and the pieces by section.
            assert _text_exchanges(cut(pages, "doc", "page"), ["text", "_cut", "_lines", "_piece"]) <= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
