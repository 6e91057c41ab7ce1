"""Literal fixtures for formats and replies; expected values written by hand."""

import json

import pandas as pd
from pyspark.sql import functions as F

from chunkmill.operators.samples import generate_responses, parse_reply_or_wrap, parse_reply_strict
from chunkmill.sources.extract import (flatten_json_to_text, html_to_text, notebook_to_text, read_csv_records,
                                       csv_records_to_text, route_by_extension)
from chunkmill.sources.store_io import load_samples_strict, read_store, write_store

REPLIES = [
    ('{"instruction": "Q", "output": "A"}', ("Q", "A")),
    ('{"instruction": "Q", "output": "A", "x": 1}', ("Q", "A")),
    ('{"instruction": "Q"}', None),
    ('["instruction", "output"]', None),
    ("42", None),
    ("null", None),
    ('text ```json\n{"instruction": "F", "output": "G"}\n``` more', ("F", "G")),
    ('```json {"instruction": "U", "output": "V"}}', ("U", "V")),
    ('Sure: {"instruction": "P", "output": "Q"} ok', ("P", "Q")),
    ('{"instruction": "X", "output": "Y"} {"instruction": "Z", "output": "W"}', None),
    ("{'instruction': 'S', 'output': 'T'}", None),
    ('{"instruction": "Q", "output": "A"} trailing', ("Q", "A")),
    ("", None),
    ("not json", None),
    ('{"instruction": 5, "output": [1, 2]}', ("5", "[1,2]")),
]


def test_parse_reply_strict(spark):
    df = spark.createDataFrame([(r,) for r, _ in REPLIES], "r string")
    got = [None if x.s is None else (x.s.instruction, x.s.output)
           for x in df.select(parse_reply_strict("r").alias("s")).collect()]
    assert got == [e for _, e in REPLIES]


def test_parse_reply_or_wrap(spark):
    df = spark.createDataFrame([('{"instruction": "Q", "output": "A", "x": 1}', "a.txt"), ("plain words", "b.txt"),
                                ('{"instruction": "Q"}', "c.txt"), ("", "d.txt")], "r string, src string")
    got = [x.s for x in df.select(parse_reply_or_wrap("r", "src").alias("s")).collect()]
    assert (got[0].instruction, got[0].output, got[0].n_keys) == ("Q", "A", 3)
    assert (got[1].instruction, got[1].output) == ("Question based on b.txt", "plain words")
    assert got[2] is None and got[3] is None


def test_flatten_json_nested_literal(spark):
    doc = {"mathematics": {"algebra": [{"name": "Binomial", "formula": "(a+b)^2"}], "empty": {}, "n": None},
           "z": [1, 2.5, True, [3]], "a": "last"}
    expected = "\n".join(["mathematics.algebra[0].name: Binomial", "mathematics.algebra[0].formula: (a+b)^2",
                          "mathematics.n: None", "z[0]: 1", "z[1]: 2.5", "z[2]: True", "z[3][0]: 3", "a: last"])
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, '"just text"'), (3, "7")], "k long, j string")
    got = {r.k: r.text for r in flatten_json_to_text(df, "k", "j").collect()}
    assert got == {1: expected, 2: ": just text", 3: ": 7"}


def test_notebook_literal(spark):
    nb = {"cells": [{"cell_type": "markdown", "source": ["# Title\n", "text"]},
                    {"cell_type": "code", "source": "x = 1", "outputs": [{"output_type": "stream", "text": ["out\n"]}]},
                    {"cell_type": "code", "source": "x", "outputs": [{"output_type": "execute_result", "data": {"text/plain": "1"}}]},
                    {"cell_type": "raw", "source": "ignored"}], "nbformat": 4, "nbformat_minor": 5}
    df = spark.createDataFrame([(json.dumps(nb),), ("not a notebook",)], "j string")
    got = [r.t for r in df.select(notebook_to_text("j").alias("t")).collect()]
    assert got == ["# Title\ntext\n\nout\n\n\n1", None]


def test_html_literal(spark):
    html = ("<html><head><title>Titel</title><style>p{}</style><script>var t='</p>';</script></head>"
            "<body><h1>Überschrift</h1>\n<p>Ein  Satz &amp; mehr &lt;b&gt; &#8364; &#x41;</p><!-- c -->\n"
            "<ul><li>eins</li><li><strong>zwei</strong></li></ul>\n   \n</body></html>")
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(html_to_text("h").alias("t")).first().t == "TitelÜberschrift\nEin\nSatz & mehr <b> € A\neinszwei"


def test_routing(spark):
    df = spark.createDataFrame([("a/B.TXT",), ("x.ipynb.py",), (".bashrc",), ("d/e.tar.gz",), ("f.htm",)], "p string")
    assert [r.l for r in df.select(route_by_extension("p").alias("l")).collect()] == ["text", None, None, None, "html"]


def test_csv_files(spark, tmp_dir):
    with open(f"{tmp_dir}/v.csv", "w") as f:
        f.write('Word,Translation,Example\nHaus,house,"Das Haus, groß"\n\nBaum,,"a ""quoted"" tree"\n')
    out = csv_records_to_text(read_csv_records(spark, tmp_dir)).first().text
    assert out == 'Word | Translation | Example\nHaus | house | Das Haus, groß\nBaum |  | a "quoted" tree'


def test_store_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a.txt", 0, "x", "{}", None)],
                               "id long, filename string, chunk_index int, chunk_text string, metadata string, created_at timestamp")
    write_store(df, f"{tmp_dir}/s")
    write_store(df.withColumn("chunk_text", F.lit("y")), f"{tmp_dir}/s")
    assert [r.chunk_text for r in read_store(spark, f"{tmp_dir}/s").collect()] == ["y"]


def test_load_samples_strict_failfast(spark):
    lines = spark.createDataFrame([('{"instruction": "a", "output": "b"}',), ("  ",), ("oops",)], "line string")
    r = load_samples_strict(lines).collect()
    assert [x.rejected for x in r] == [False, True]
    try:
        load_samples_strict(lines, failfast=True)
        raise AssertionError("expected failure")
    except ValueError:
        pass


def test_generator_retries_then_reports(spark):
    calls = {"n": 0}

    def flaky(prompts: pd.Series) -> pd.Series:
        raise RuntimeError("service down")

    df = spark.createDataFrame([(1, "p")], "id long, prompt string")
    r = generate_responses(df, "prompt", flaky, retries=2, backoff=0.0).first()
    assert r.reply is None and r.error == "service down" and r.attempts == 2
    ok = generate_responses(df, "prompt", lambda s: s.str.upper(), backoff=0.0).first()
    assert ok.reply == "P" and ok.error is None and ok.attempts == 1
    assert calls["n"] == 0


def test_jsonl_lines_keep_metadata_order(spark):
    from chunkmill.sources.store_io import jsonl_lines

    df = spark.createDataFrame([("a.txt", 0, "tëxt", '{"source": "a.txt", "chunk_index": 0, "file_type": ".txt"}'),
                                ("b.txt", 0, "x", "not json"), ("c.txt", 1, "y", None)],
                               "filename string, chunk_index int, chunk_text string, metadata string")
    got = {r.filename: r.line for r in jsonl_lines(df).collect()}
    assert got["a.txt"] == ('{"filename":"a.txt","chunk_index":0,"text":"tëxt",'
                            '"metadata":{"source":"a.txt","chunk_index":0,"file_type":".txt"}}')
    assert got["b.txt"].endswith('"metadata":{}}') and got["c.txt"].endswith('"metadata":{}}')
    assert json.loads(got["a.txt"])["metadata"]["file_type"] == ".txt"


def test_single_json_export(spark, tmp_dir):
    import glob

    from chunkmill.sources.store_io import export_single_json, json_fragments, json_offsets

    schema = "filename string, chunk_index int, chunk_text string, metadata string"
    few = spark.createDataFrame([("b.txt", 1, "y\nz", "{}"), ("b.txt", 0, "x", '{"k": 1}'), ('a"q.txt', 0, "zé", None)], schema)
    many = spark.range(500).selectExpr("concat('f', id % 7, '.txt') filename", "cast(id div 7 as int) chunk_index", "repeat('ü', int(id % 9)) chunk_text",
                                       "cast(null as string) metadata")
    for n, df in enumerate((few, many, few.limit(0))):
        path = f"{tmp_dir}/one-{n}"
        export_single_json(df, path, "2024-01-01T00:00:00")
        whole = b"".join(open(f, "rb").read() for f in sorted(glob.glob(path + "/part-*")))
        doc, rows = json.loads(whole), df.collect()
        assert doc["export_date"] == "2024-01-01T00:00:00" and doc["total_chunks"] == len(rows)
        assert list(doc["documents"]) == sorted({r.filename for r in rows}) and doc["total_documents"] == len(doc["documents"])
        for name, chunks in doc["documents"].items():
            want = sorted((r for r in rows if r.filename == name), key=lambda r: r.chunk_index)
            assert chunks == [{"chunk_index": r.chunk_index, "text": r.chunk_text, "metadata": json.loads(r.metadata or "{}")} for r in want]
        text = {r.row_no: r.fragment for r in json_fragments(df, "2024-01-01T00:00:00").where("section = 1").collect()}
        offsets = json_offsets(df, "2024-01-01T00:00:00").collect()
        assert len(offsets) == len(rows)
        for r in offsets:
            assert whole[r.byte_offset:r.byte_offset + r.n_bytes].decode() == text[r.row_no] + "\n"


def test_append_dialogs_and_require_rows(spark, tmp_dir):
    from chunkmill.operators.samples import append_dialogs, build_dialogs
    from chunkmill.sources.store_io import require_rows

    turns = spark.createDataFrame([(1, 1, "assistant", "hi"), (1, 0, "user", "hello")], "conv_id long, turn long, role string, text string")
    append_dialogs(build_dialogs(turns), f"{tmp_dir}/d")
    append_dialogs(build_dialogs(turns), f"{tmp_dir}/d")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_dir}/d").collect()]
    assert len(lines) == 2 and lines[0]["messages"] == [{"role": "user", "content": "hello"}, {"role": "assistant", "content": "hi"}]
    try:
        require_rows(turns.limit(0), "No training samples found")
        raise AssertionError("expected failure")
    except ValueError as e:
        assert str(e) == "No training samples found"


def test_csv_file_text_native(spark):
    import csv
    import io

    from chunkmill.sources.extract import csv_file_to_text

    texts = ['Word,Translation,Example\nHaus,house,"Das Haus, groß"\n\nBaum,,"a ""quoted"" tree"\n',
             'a,b\n1,2,3,4\n"multi\nline",x\r\nlast,\n',
             ',lead\n"",empty quoted\n']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.x for r in df.select(csv_file_to_text("t").alias("x")).collect()]
    for t, g in zip(texts, got):
        rows = [r for r in csv.reader(io.StringIO(t.replace("\r\n", "\n"), newline="")) if r]
        assert g == "\n".join(" | ".join(r) for r in rows), (t, g)


def test_notebook_v3_worksheets(spark):
    nb3 = {"worksheets": [{"cells": [{"cell_type": "markdown", "source": ["intro"]},
                                     {"cell_type": "code", "input": "1+1", "outputs": [{"output_type": "pyout", "text": ["2"]}]}]}],
           "nbformat": 3}
    df = spark.createDataFrame([(json.dumps(nb3),)], "j string")
    assert df.select(notebook_to_text("j").alias("t")).first().t == "intro\n\n2"
