"""Scoring against plain loops, headers of long files, and rows that share an id."""

import re
import time

import numpy as np
from pyspark.sql import functions as F

from sievetext.llm import license, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_logits_equal_the_pass_that_trains():
    rng = np.random.default_rng(2)
    net = toxicity.Net.fresh(3)
    net.p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in net.p.items()}
    gates = rng.normal(size=(50, 6 * toxicity.HIDDEN)).astype(np.float32)
    for lengths in ([7] * 5, [1, 7, 3, 7, 2]):
        places, lengths = rng.integers(0, 50, (5, 7)), np.array(lengths)
        assert np.allclose(net.logits(gates, places, lengths), net._forward(gates, places, lengths, None)[0], atol=1e-5)


def test_scorer_equals_a_loop_over_windows():
    rng = np.random.default_rng(4)
    net = toxicity.Net.fresh(5)
    net.p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in net.p.items()}
    texts = [" ".join(f"w{rng.integers(40)}" for _ in range(n)) for n in (0, 1, 5, 64, 65, 200, 1000)]
    texts += [texts[4], "", texts[6], "É \ud800 x"]
    scores = list(toxicity.Scorer(net).scores(texts))
    for text, score in zip(texts, scores, strict=True):
        best = -np.inf
        words = toxicity.split_words(text)
        for start in toxicity.window_starts(len(words)):
            own = words[start : start + toxicity.WINDOW]
            gates = net.gates(net.inputs(toxicity.Codes.of(own)))
            best = max(best, float(net._forward(gates, np.arange(len(own))[None, :], np.array([len(own)]), None)[0][0]))
        assert abs(score - 1 / (1 + np.exp(-best))) < 1e-5


def plain_header(text):
    text = re.sub(r"^[ \t\n\x0b\f\r]+", "", text)
    if block := re.match(r"/\*.*?\*/", text, re.S):
        return block[0]
    lines = text.split("\n")
    comment = re.compile(r"\s*" + license.COMMENT)
    same = comment.match if comment.match(lines[0]) else re.compile(r".*\S").match
    taken = []
    for line in lines:
        if not same(line):
            break
        taken.append(line)
    return "\n".join(taken)


def test_headers(spark):
    texts = [
        "", " \n ", "one paragraph\nof two lines\n\nnext", "// a\n  # b\n; c\ncode // d", "/* block\nof lines */ code\n", "/* never closed\nand on",
        "* a\r\n* b\r\n\r\nrest", "\n\n-- sql\n--more\nselect", "word", "a\n \t \nb", "<!-- x -->\n<p>", "# only\n# comments",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for row in rows.withColumn("h", license.header(F.col("t"))).collect():
        assert row.h.split() == plain_header(row.t).split(), row.t


def test_headers_of_long_files_take_seconds(spark):
    body = "\n".join(f"line {i} of the log" for i in range(100_000))
    files = [("a/1.log", body), ("a/2.log", "# c\n" * 100_000), ("a/3.log", "x " * 400_000), ("a/4.txt", "/* " + body)]
    rows = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id long, path string, text string")
    begin = time.time()
    assert {r.source for r in license.scan(rows).collect()} == {"none"}
    assert time.time() - begin < 90


def test_rows_that_share_an_id_keep_their_texts(spark):
    a = "the first text has these words and no others at all in it"
    b = "a wholly different one speaks about rain and wind over hills"
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in ((1, a), (1, b), (2, b), (2, b), (3, None), (None, a))], SCHEMA)
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.keep_first(rows).collect())
    assert [t for i, t in kept if i == 1] == sorted([a, b]) and (3, None) in kept and (0, a) in kept
    assert not [i for i, _ in kept if i == 2]
    assert simhash.keep_first(rows.limit(0)).collect() == []
