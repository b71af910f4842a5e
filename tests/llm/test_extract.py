import html
import re

import pytest

from parley.llm import extract as X

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return X.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_articles_come_back(spark, model):
    for r in X.extract(spark.read.parquet(f"{SF}/pages.parquet"), model).collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S).group(1)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert r["main_text"] == "\n".join(x for x in want if x)


def test_held_out_layouts(model):
    right = total = 0
    for blocks, labels in X.training_pages(200, seed=99):
        got = model.decode(blocks)
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total >= 0.97


def test_viterbi_is_the_best_path(model):
    import itertools
    for blocks, _ in X.training_pages(40, seed=5):
        blocks = blocks[:8]

        def value(path):
            v, prev = 0.0, None
            for i, (b, y) in enumerate(zip(blocks, path)):
                v += sum(model.weight.get(f, 0.0) for f in X.features(b, prev)) if y else 0.0
                v += model.start[y] if i == 0 else model.step[path[i - 1]][y]
                prev = b
            return v
        best = max(map(value, itertools.product((0, 1), repeat=len(blocks))))
        assert abs(value([int(y) for y in model.decode(blocks)]) - best) < 1e-9


def test_gradient_training_beats_the_start():
    pages = X.training_pages(60, seed=8)
    m = X.train(pages, rounds=40)
    right = sum(a == b for p, y in pages for a, b in zip(m.decode(p), y))
    assert right / sum(len(y) for _, y in pages) > 0.97


def test_blocks():
    page = ("<!DOCTYPE html><div class='A'>one <b>t</b>wo&nbsp;&amp;\n three<p>open<br>line<p>next<!-- x <p>no --></div>"
            "<script>var t='</p>';</script><ul><li>a<li><a href=\"x>y\">link</a></ul>5 < 6 <unclosed")
    assert [b.text for b in X.leaf_blocks(page)] == ["one two & three", "open line", "next", "a", "link", "5 < 6 <unclosed"]
    assert X.leaf_blocks(page)[4].link_share == 1 and X.leaf_blocks("<p>a<!-- open") [0].text == "a"


def test_edges(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (3, "<script>1", "x"), (4, "<article><p>" + "word " * 60_000 + "</p></article>", "x"),
            (5, "<article><h1>T</h1><p>Some words here.</p></article>", "x"),
            (5, "<article><h1>T</h1><p>Some words here.</p></article>", "x")]
    got = X.extract(spark.createDataFrame(rows, "page_id int, html string, main_text string"), model).collect()
    assert [r["main_text"] for r in got[:3]] == ["", "", ""]
    assert len(got[3]["main_text"]) == 60_000 * 5 - 1 and got[4]["main_text"] == got[5]["main_text"] != ""
    empty = spark.createDataFrame([], "page_id int, html string")
    assert X.extract(empty, X.fit(empty, generated=30, rounds=5)).count() == 0
