"""Parsers on hand-written inputs."""

from pyspark.sql import functions as F

from knotwork.sources import conversations as V
from knotwork.sources import files as L
from knotwork.sources import texts as T


def test_markdown(spark):
    text = "---\ntitle: My page\nsize: 3\nsize: 4\n---\nintro\n# One\ntext\n### Deep\n```\n# fence\n```\n## Mid\nm\n# Two\n"
    df = spark.createDataFrame([(1, text), (2, "no heading"), (3, None), (4, ""), (5, "# only")], "k long, t string")
    got = [tuple(r) for r in T.markdown_sections(df, "k", "t").orderBy("k", "sec_no").collect()]
    assert [(k, n, p, d, t) for k, n, p, d, t, _ in got] == [(1, 0, None, 1, "Content"), (1, 1, None, 1, "One"), (1, 2, 1, 3, "Deep"), (1, 3, None, 1, "fence"), (1, 4, 3, 2, "Mid"), (1, 5, None, 1, "Two"), (2, 0, None, 1, "Content"), (5, 1, None, 1, "only")]
    assert got[1][5] == "text" and got[4][5] == "m"
    row = df.select(T.front_matter(F.col("t")).alias("m"), T.markdown_title(F.col("t")).alias("h")).collect()
    assert row[0].m == {"title": "My page", "size": "4"} and row[0].h == "One" and row[1].m == {} and row[1].h == "Untitled"


def test_html(spark):
    html = """<html><head><title>T</title><style>x{}</style></head><body><header><h1>Gone</h1></header><p>before</p><h1>Main <b>one</b></h1><p>a<br>b</p>
    <pre>code</pre><div><h2>inner</h2> text</div><h2>Empty</h2><h2>Last</h2><p>z</p><nav>n</nav><div class="sidebar x">s</div></body></html>"""
    title, sections = L.page_sections(html, "f")
    assert title == "Main one" and [(d, t) for d, t, _ in sections] == [(1, "Main one"), (2, "Last")]
    assert sections[0][2] == "ab\n\n```\ncode\n```\n\ninner text" and sections[1][2] == "z"
    assert L.page_sections("<p>only</p>", "f") == ("f", [(1, "Content", "only")])
    page = "<body><p>menu</p><main><h1>A</h1><p>one</p><h2>B</h2><p>two</p></main><p>foot</p></body>"
    assert L.page_sections(page, "f") == ("A", [(1, "A", "one"), (2, "B", "two")])
    assert L.page_sections("<main><article><h1>A</h1><p>one</p></article><article><h2>B</h2><p>two</p></article></main>", "f")[1] == [(1, "A", "one"), (2, "B", "two")]
    assert L.page_sections("<main></main><p>x</p>", "f")[1] == [(1, "Content", "x")]
    df = spark.createDataFrame([("a", html), ("b", None), ("c", "")], "k string, h string")
    assert L.html_sections(df, "k", "h").count() == 2


def test_subtitles(spark):
    srt = "WEBVTT\n\n" + "\n\n".join(f"{i}\n00:00 --> 00:01\nline {i}\nmore" for i in range(1, 12)) + "\n"
    df = spark.createDataFrame([(srt,), ("",), ("1\r\n0 --> 1\r\nhi\r\n",)], "t string")
    got = [r[0] for r in df.select(T.subtitle_sections(F.col("t"))).collect()]
    assert [s.title for s in got[0]] == ["Transcript 1-10", "Transcript 11-11"] and got[0][1].content == "line 11 more"
    assert got[1] == [] and got[2][0].content == "hi"


def test_papers_tables_and_json(spark):
    df = spark.createDataFrame([(1, "lost\nAbstract\nwe did.\n1. Method\nx y.\nResults\n"), (2, "plain text.\nmore text."), (3, "")], "k long, t string")
    assert [(r.k, r.title, r.content) for r in T.paper_sections(df, "k", "t").orderBy("k", "sec_no").collect()] == [(1, "Abstract", "we did."), (1, "1. Method", "x y."), (2, "Content", "plain text.\nmore text.")]
    rows = spark.createDataFrame([("f", i, f"v{i}" if i else None, i) for i in range(11)], "file string, i long, a string, b int")
    got = T.table_sections(rows, "file", "i", ["a", "b"]).orderBy("sec_no").collect()
    assert [r.title for r in got] == ["Schema", "Rows 1-10", "Rows 11-11"] and got[1].content.startswith("a: N/A, b: 0\na: v1") and "11 rows and 2 columns: a, b." in got[0].content
    js = spark.createDataFrame([('[{"a": 1, "b": "x"}, 5]',), ('{"k": {"z": 1}, "l": "t"}',), ("oops",)], "t string")
    got = [r[0] for r in js.select(T.json_sections(F.col("t"))).collect()]
    assert [s.title for s in got[0]] == ["Overview", "Items 1-2"] and got[0][1].content == "a: 1, b: x\n5" and [s.title for s in got[1]] == ["k", "l"] and got[2] is None


def test_chats(spark):
    gpt = '{"title": "t", "mapping": {"1": {"message": {"author": {"role": "user"}, "content": {"parts": ["hi"]}}}, "2": {"message": null}, "3": {"message": {"author": {"role": "system"}, "content": {"parts": ["s"]}}}}}'
    slack = '{"channel": "c", "messages": [{"type": "message", "text": "yo", "ts": "1.5"}, {"type": "message", "text": "bot", "bot_id": "B"}, {"type": "join"}]}'
    texts = [("claude", "Human: a\n\nb\n\nAssistant: c\n\nUser: d"), ("gpt", gpt), ("slack", slack), ("raw", "one\n\ntwo\n\n\nthree"), ("bad", '{"mapping" "message" oops'), ("none", None), ("empty", "")]
    got = V.parse_chats(spark.createDataFrame(texts, "k string, t string"), "k", "t").orderBy("k", "pos").collect()
    of = lambda k: [(r.role, r.text) for r in got if r.k == k]
    assert of("claude") == [("user", "a\n\nb"), ("assistant", "c"), ("user", "d")] and of("gpt") == [("user", "hi")] and of("slack") == [("user", "yo"), ("assistant", "bot")]
    assert of("raw") == [("user", "one"), ("assistant", "two"), ("user", "three")] and of("bad") == [("user", '{"mapping" "message" oops')] and of("none") == of("empty") == []
    df = spark.createDataFrame([("x", 0, "user", "q" * 90), ("x", 1, "system", "s"), ("x", 2, "assistant", "a"), ("x", 3, "user", "b"), ("y", 0, "assistant", "z")], "k string, pos int, role string, text string")
    assert {r.k: r.title for r in V.chat_titles(df, "k").collect()} == {"x": "q" * 80 + "...", "y": "Untitled Conversation"}
    assert [r.title for r in V.turn_sections(df, "k").where("k = 'x'").orderBy("sec_no").collect()] == ["User (turn 1)", "Assistant (turn 1)", "User (turn 2)"]


def test_evaluation_set(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"question_id": "a_abs", "question_type": "t", "question_date": "2023/03/31 (Fri) 14:13", "haystack_session_ids": ["s"], "haystack_dates": [], "haystack_sessions": [[{"role": "user", "content": "x"}], [{"role": "user", "content": "y"}]]}, {"question_id": "b", "question_type": "u", "haystack_sessions": []}]')
    rows = V.load_questions(spark, str(tmp_path / "q.json"))
    assert rows.count() == 2 and V.load_questions(spark, str(tmp_path / "q.json"), ["u"], 5).count() == 1
    got = V.session_messages(rows).orderBy("session_id").collect()
    assert [(r.session_id, r.session_date, r.text) for r in got] == [("s", "2023-03-31 (Fri)", "x"), ("session_1", "2023-03-31 (Fri)", "y")]


def test_results_and_binary_files(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert L.read_results(spark, str(tmp_path / "r.jsonl"), "a int").count() == 2
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.bin").write_bytes(b"ok")
    (tmp_path / "b" / "y.bin").write_bytes(b"\xff")
    got = {r.file.rsplit("/", 1)[1]: r.text for r in L.binary_texts(spark, str(tmp_path / "b"), lambda b: b.decode()).collect()}
    assert got == {"x.bin": "ok", "y.bin": None}


def test_image_and_film_headers(spark, tmp_path):
    import struct

    from knotwork.sources.media import film_text, jpeg_text

    make = b"Acme\0"
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 271, 2, len(make), 26) + struct.pack("<I", 0) + make
    app = b"Exif\0\0" + tiff
    frame = struct.pack(">BHHB", 8, 30, 40, 0)
    jpeg = b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc0" + struct.pack(">H", len(frame) + 2) + frame + b"\xff\xda"
    assert jpeg_text(jpeg) == "Image is 40x30 pixels.\nCamera make: Acme."
    mvhd = struct.pack(">I4sIIIII", 28, b"mvhd", 0, 0, 0, 1000, 2500)
    film = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 8 + len(mvhd), b"moov") + mvhd
    assert film_text(film) == "Container is isom.\nFilm lasts 2.5 seconds."
    (tmp_path / "a.jpg").write_bytes(jpeg)
    (tmp_path / "b.jpg").write_bytes(b"no")
    got = {r.file.rsplit("/", 1)[1]: r.text for r in L.binary_texts(spark, str(tmp_path), jpeg_text, "*.jpg").collect()}
    assert got["a.jpg"].startswith("Image") and got["b.jpg"] is None
