"""Corpus operators on pages, conversations and vectors."""

import json
import random

import numpy as np

from tallyframe.llm import ann, chat_format, html_extract

# HTML


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    chance = random.Random(6)
    for _ in range(150):
        a, b = ([chance.randrange(6) for _ in range(chance.randrange(25))] for _ in range(2))
        for bits in (1 << 26, 8):
            pairs = html_extract.common_lines(a, b, bits)
            assert len(pairs) == longest(a, b)
            assert all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def lines(page):
    return "\n".join(t for t, k in html_extract.text_lines(page) if k != html_extract.MARKED)


def test_blocks_and_noise():
    assert lines("<p>a <b>b</b>\n c<p>d&amp;e&nbsp;f") == "a b c\nd&e f"
    assert lines("<nav><p>m</p></nav><header>h</header><div class='ad box'>x</div><main><p>t</main><footer>f") == "t"
    assert lines("<script>var t='</p>';</script><style>p{}</style><!-- c --><p>a<br>b<form><input>q</form>") == "a b"
    assert lines("<div id=comments><p>c</div><aside>s</aside><p role=navigation>n</p><p hidden>h</p><h1>T</h1><ul><li>1<li>2</ul>") == "T\n1\n2"
    assert lines("<p>a < b</p><p>c") == "a < b\nc"
    assert lines("<article><div class=notice>n</div><p>x") == "x"
    assert lines("<article><p>t</article><article class='comment'><p>me too</article>") == "t"
    assert lines("<div class='content with-sidebar'><p>Main text</p><p class='search'>x</div><div class='sidebar'>s</div><p class='notice'>n") == "Main text\nx"
    assert lines("<p>a <span class=ad>buy</span> b") == "a b"
    assert html_extract.text_lines("<nav>m</nav><article>t</article><p>o") == [("m", html_extract.MARKED), ("t", html_extract.SAFE), ("o", html_extract.OPEN)]
    assert lines("") == "" and lines("<<<>>>") != "never raises"


def test_extract(spark):
    shared = "<div>Home</div><div>Shared words</div>"
    rows = [(1, "http://a.com/x/1", shared + "<p>One and more"), (2, "http://a.com/x/2", shared + "<p>Two"), (3, "http://a.com/x/3", f"<article>{shared}<p>Three</article>"), (4, "http://b.com/x/1", shared + "<p>One"), (5, None, None), (6, "bad url[", ""), (None, "http://a.com/x/9", "<p>No id"), (7, "http://c.com/", "<p>" + "long words " * 30_000), (8, "http://d.com/1", "<p>twice"), (8, "http://d.com/1", "<p>twice")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS page")
    found = html_extract.extract_text(df)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = {r["page_id"]: r["text"] for r in found.collect()}
    assert got[1] == "One and more" and got[2] == "Two"
    assert got[3] == "Home\nShared words\nThree"  # an article's own lines are safe
    assert got[4] == "Home\nShared words\nOne"  # no neighbour on its host
    assert got[5] == got[6] == "" and got[None] == "No id" and len(got[7]) == 11 * 30_000 - 1
    assert got[8] == "twice" and found.count() == len(rows)
    assert html_extract.extract_text(df.where("false")).count() == 0


def test_differencing_decides_where_markup_says_nothing(spark):
    """Pages without any telling markup: menus, adverts and footers that come back go by the alignment alone."""
    chance = random.Random(9)
    words = lambda n: " ".join("".join(chance.choices("abcdefghij", k=6)) for _ in range(n))
    menu, foot, rows, want = [words(2) for _ in range(6)], [words(5) for _ in range(2)], [], {}
    for i in range(40):
        body = [words(30) for _ in range(chance.randrange(1, 6))]
        want[i] = "\n".join(body)
        rows.append((i, f"http://h.com/p/{i // 7}/{i}.html", "".join(f"<div class='x{k}'>{t}</div>" for k, t in enumerate([*menu, *body, *foot]))))
    body = [words(30) for _ in range(12)]
    for i, text in ((50, body), (51, body), (52, [*body[:-1], body[-1] + " x"])):  # a copy and a near copy
        want[i] = "\n".join(text)
        rows.append((i, f"http://i.com/{i}", "".join(f"<p>{t}" for t in text)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert {r["page_id"]: r["text"] for r in html_extract.extract_text(df).collect()} == want
    report = html_extract.line_report(df).first()
    assert report["shared"] == 40 * 8 and report["marked"] == 0


def test_alignment_and_markup_share_the_work(spark, small):
    report = html_extract.line_report(spark.read.parquet(f"{small}/pages.parquet")).first()
    assert report["shared"] > 0 and report["marked"] > 0


def test_pages_against_their_articles(spark, small):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in html_extract.op1_html_extract(spark, small).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", article).replace("<br>", " "))
        assert r["text"] == "\n".join(x for x in (re.sub(r"\s+", " ", html.unescape(b)).strip() for b in blocks) if x)
        assert r["n_chars"] == len(r["text"])


# chats


def test_template_round_trip():
    texts = ["", "\\", "a\\<s>", "<<SYS>>x<</SYS>>[INST][/INST]<s></s><|end|><|a|>|>", "\\a\\b", "<", "[INST", "</s", "\n\r\t\\\n", "|"]
    for text in texts:
        for role in ("user", "assistant", "system", "tool", "a|", "", ">x", "\\", "<|x|>"):
            turns = [(role, text), ("assistant", text), (role, text + "<")]
            line, spans = chat_format.write_chat(turns)
            assert chat_format.read_chat(line) == turns
            assert [chat_format.unescape(line[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_layouts():
    turns = lambda record: [(r, t) for _, r, t in chat_format.canonical_turns(record)[1]]
    assert turns({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}], "extra": {"a": [1]}}) == [("user", "q"), ("assistant", "")]
    assert turns({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}) == [("user", "q"), ("assistant", "a")]
    assert turns({"instruction": "i", "input": "x", "output": "o"}) == [("user", "i\nx"), ("assistant", "o")]
    assert turns({"instruction": "i", "input": "", "output": "o", "system": "s"}) == [("system", "s"), ("user", "i"), ("assistant", "o")]
    assert turns({"prompt": "p", "completion": "c"}) == turns({"prompt": "p", "response": "c"}) == turns({"question": "p", "answer": "c"}) == [("user", "p"), ("assistant", "c")]
    for bad in ({}, {"prompt": "p"}, [1], None, "x"):
        assert chat_format.canonical_turns(bad) is None


def test_chats_of_odd_rows(spark):
    records = [(1, json.dumps({"messages": [{"role": "user", "content": "</s>"}]})), (2, "{bad"), (3, None), (4, json.dumps({"odd": 1})), (5, json.dumps({"prompt": "p", "completion": "c" * 100_000}))]
    records += [(9, json.dumps({"conv_id": c, "turn": t, "role": r, "text": x})) for c, t, r, x in ((7, 2, "assistant", "b"), (7, 1, "user", None), (7, 1, "user", None), (None, None, None, "z"))]
    df = spark.createDataFrame(records, "record_id long, record string").selectExpr("*", "'x' AS role", "1 AS turn")
    chats = {r["conversation"]: chat_format.read_chat(r["formatted"]) for r in chat_format.format_chats(chat_format.turns_of(df)).collect()}
    assert chats[1] == [("user", "</s>")] and chats[7] == [("user", ""), ("user", ""), ("assistant", "b")] and chats[None] == [("", "z")]
    assert chats[5][1] == ("assistant", "c" * 100_000)
    assert sorted(r["id"] for r in chat_format.unmapped(df).collect()) == [2, 3, 4]
    assert chat_format.digests(chat_format.format_chats(chat_format.turns_of(df.where("false")))).count() == 0


# vectors


def test_recall_and_scores(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    found = {}
    for r in ann.op9_nearest_vectors(spark, small).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    size, hits = np.sqrt((x * x).sum(axis=1)), 0
    for q in np.flatnonzero(ids % 50 == 0):
        cosine = x @ x[q] / size / size[q]
        cosine[q] = -2
        want = ids[np.lexsort((ids, -cosine))[:5]].tolist()
        got = sorted(found[ids[q]])
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        assert np.allclose([g[2] for g in got], [cosine[np.flatnonzero(ids == g[1])[0]] for g in got], atol=1e-12)
        hits += len(set(want) & {g[1] for g in got})
    assert hits >= 0.9 * 5 * len(found) and len(found) == (ids % 50 == 0).sum()


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (9, []), (None, [1.0, 1.0]), (100, None), (10, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [1.0, 0.0]), (13, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "2 AS score")
    from pyspark.sql import functions as F

    found = ann.search(df, F.col("vec_id") % 50 == 0)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [0, 50]
    assert [v for _, v, _ in sorted(got[0])] == [1, 2, 3, 10, 11] and all(s == 1 for _, _, s in got[0])
    assert [v for _, v, _ in sorted(got[50])] == [0, 1, 2, 3, 10]
    assert ann.search(df.where("vec_id < 1"), F.col("vec_id") == 0).count() == 0
    assert ann.search(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_rows_that_repeat_ids(spark):
    same, other = [1.0, 0.0, 0.0], [0.9, 0.1, 0.0]
    rows = [(50, same)] * 8 + [(60, same), (61, other), (62, [0.5, 0.5, 0.0]), (63, [0.0, 0.0, 1.0]), (50, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(df, ann.F.col("vec_id") == 50).select("query_id", "rank", "vec_id").distinct().collect()
    lists = {}
    for r in sorted(found, key=lambda r: (r["rank"], r["vec_id"])):
        lists.setdefault(r["rank"], set()).add(r["vec_id"])
    # 60, 61, 62, 50, 63 for the rows of the first vector; 62, 61, 50, 60, 63 for the other row of id 50.
    assert lists == {1: {60, 62}, 2: {61}, 3: {62, 50}, 4: {50, 60}, 5: {63}}
    first = [r["vec_id"] for r in ann.search(df.where("vec_id <> 50").unionByName(df.where("vec_id = 50").limit(8)), ann.F.col("vec_id") == 50).where("rank = 1").distinct().collect()]
    assert 60 in first


def test_records_that_fit_nothing(spark):
    deep = "[" * 100_000 + "]" * 100_000
    nested = json.dumps({"messages": [{"role": "u", "content": "x"}]})[:-1] + ', "x": ' + "[" * 900 + "]" * 900 + "}"
    bad = ['{"messages":[{"role":"u","content":"x"}, null]}', '{"messages":[{"role":"u","content":"x"}, "content"]}', '{"messages":[{"role":"u","content":"x"}, {"role":["a"],"content":"y"}]}', deep, '{"conv_id":"x","turn":1,"role":"user","text":"t"}', '{"conv_id":1,"turn":1.5,"role":"user","text":"t"}', '{"conv_id":99999999999999999999,"turn":1,"role":"user","text":"t"}', "7", None, "{", '{"messages":"content"}']
    good = [nested, '{"conv_id":null,"turn":null,"role":null,"text":null}', '{"messages":[{"role":"user","content":"\\ud800"}]}', '{"conversations":[{"from":"human","value":3}]}']
    df = spark.createDataFrame(list(enumerate([*bad, *good])), "record_id long, record string")
    assert {r["id"] for r in chat_format.unmapped(df).collect()} == set(range(len(bad)))
    turns = chat_format.turns_of(df)
    assert {(r["role"], r["text"]) for r in turns.collect()} == {("u", "x"), ("", ""), ("user", "\ufffd"), ("user", "3")}
    assert chat_format.digests(chat_format.format_chats(turns)).count() == 4
