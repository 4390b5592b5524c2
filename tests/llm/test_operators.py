"""The operators on small tables, against brute force, with the cases that tables may hold."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from sievetext.llm import bpe, ctw, license, packing, paragraphs, quality, search, simhash, token_files, toxicity
from sievetext.llm.common import components
from sievetext.llm.encoding import tokenizer_path
from sievetext.llm.oracles import ORACLES
from sievetext.llm.queries import REGISTRY
from tools.check_oracles import compare, duck

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, _text string, band array<int>"
PASSAGE = " ".join(f"shared{i} word{i % 7}" for i in range(40))
LONG = " ".join(f"w{i}" for i in range(6000))


def row(doc_id, text):
    return (doc_id, text, None, "src", None, "k", "clash", [1, None])


ROWS = [
    row(1, "The quick brown fox jumps over the lazy dog"),
    row(2, "the QUICK brown fox jumps over the lazy dog"),
    row(2, "the QUICK brown fox jumps over the lazy dog"),
    row(3, None),
    row(4, ""),
    row(5, " \n\t "),
    row(6, f"first text begins here and {' '.join(f'p{i}' for i in range(30))} {PASSAGE} then goes on\nwith another line."),
    row(7, f"a different one {' '.join(f'q{i}' for i in range(30))} {PASSAGE} ends otherwise"),
    row(8, LONG),
    row(9, LONG + " end"),
    row(None, "a text without an id, of some words"),
    row(None, None),
    row(10, "one two " * 30),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 0, 1), (7, 1, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")


def test_operators_return_no_rows_for_empty_tables(spark, none, labels):
    found = [
        simhash.near_duplicates(none), token_files.written_and_read(none), quality.judge(none), ctw.score(none), bpe.digests(none), bpe.encode(none),
        packing.pack(none), toxicity.score(none, labels), paragraphs.repeated_passages(none),
        license.scan(none.withColumn("path", F.lit("a"))), search.search(none, none.selectExpr("doc_id query_id", "text")),
    ]
    assert [x.count() for x in found] == [0] * len(found)


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    pairs = [(9, 5), (5, 7), (7, 2), (11, 11), (3, 4), (4, 3), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)]
    df = spark.createDataFrame([*pairs, (None, 2)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == brute_components(pairs, {x for p in pairs for x in p})


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(docs):
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    prints = [(r[0], plain_fingerprint(r[1])) for r in ROWS]
    values = {v for _, v in prints}
    near = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3]
    classes = brute_components(near, values)
    lowest = {c: min((i for i, v in prints if i is not None and classes[v] == c), default=None) for c in classes.values()}
    assert got == Counter((i, f"{v:016x}", lowest[classes[v]]) for i, v in prints)


@pytest.mark.parametrize("bucket", [1, 2048])
def test_large_buckets_lose_no_link(spark, bucket):
    rng = np.random.default_rng(4)
    values = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 40)]
    values += [v ^ sum(1 << int(b) for b in rng.integers(0, 62, 3)) for v in values] + [v ^ 1 for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in set(values)], "fp long"), 3, bucket)
    got = brute_components([tuple(r) for r in links.collect()], set(values))
    near = [(a, b) for a in set(values) for b in set(values) if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert got == brute_components(near, set(values))


def test_keep_first_keeps_columns_and_rows_without_id(docs):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, 6, 7, 8, 10, None, None])


def test_token_files(docs):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want, at = Counter(), 0
    for r in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want[r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        at += len(ids)
    assert Counter(tuple(r) for r in token_files.written_and_read(docs).collect()) == want


def test_token_lookup_of_some_and_unknown_keys(spark, docs):
    tokens = token_files.write(docs)
    keys = spark.createDataFrame([(2, 0), (2, 1), (2, 2), (77, 0), (7, 0)], "doc_id long, nth long")
    got = {(r["doc_id"], r["nth"]): r["ids"] for r in tokens.ids(tokens.lookup(keys)).collect()}
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert set(got) == {(2, 0), (2, 1), (7, 0)}
    assert got[7, 0] == [*library.encode(ROWS[7][1]).ids, 2]


def test_quality_order_changes_no_verdict(docs):
    got = Counter((r["doc_id"], r["n_words"], r["kept"]) for r in quality.judge(docs).collect())
    kept = {8: True, 9: True, 6: True, 7: True}
    assert got == Counter((r[0], len((r[1] or "").split()), kept.get(r[0], False)) for r in ROWS)
    assert Counter(r["doc_id"] for r in quality.keep_good(docs).collect()) == Counter([6, 7, 8, 9])
    assert quality.keep_good(docs).columns == docs.columns


def test_bpe_digests(docs):
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    library.no_truncation()
    want = Counter()
    for r in ROWS:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digests(docs).collect()) == want


def test_packing_is_gapless_and_whole(docs):
    pieces = [r.asDict() for r in packing.pack(docs, capacity=100).collect()]
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    library.no_truncation()
    want = Counter()
    for r in ROWS:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 100)):
            part = ids[start : start + 100]
            want[r[0], piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces) == want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 100


def test_ctw_base_and_order(spark, docs):
    got = ctw.score(docs).collect()
    held = {r[0]: zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 10 == 0 for r in ROWS}
    counts = Counter(w for r in ROWS if not held[r[0]] for w in [*(r[1] or "").encode().lower().split(), None])
    total = sum(counts.values())
    base = lambda words: sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in words)
    want = sorted((repr(r[0]), held[r[0]], len(w), sum(counts[x] > 0 for x in w), total, round(base(w), 5)) for r in ROWS for w in [[*(r[1] or "").encode().lower().split(), None]])
    assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    again = ctw.score(spark.createDataFrame(ROWS[::-1], SCHEMA).repartition(5)).collect()
    key = lambda r: (repr(r["doc_id"]), round(r["score"], 6))
    assert sorted(map(key, got)) == sorted(map(key, again)) and all(r["score"] < 0 for r in got)


def test_ctw_rare_units_are_joined(docs, monkeypatch):
    whole = sorted((repr(r["doc_id"]), r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in ctw.score(docs).collect())
    monkeypatch.setattr(ctw, "COMMON_GRAMS", 20)
    monkeypatch.setattr(ctw, "COMMON_WORDS", 3)
    assert whole == sorted((repr(r["doc_id"]), r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in ctw.score(docs).collect())


@pytest.mark.parametrize("part", [1 << 17, 300])
def test_ctw_parts_of_one_last_byte_give_the_whole_tree(spark, monkeypatch, part):
    monkeypatch.setattr(ctw, "PART_GRAMS", part)
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abc "), 3000)).encode()
    units, counts = np.unique(np.concatenate([ctw.text_grams(text), ctw.text_grams(b"the cab, the bac")]), return_counts=True)
    last = units >> np.uint64(8 * ctw.DEPTH)
    root = ctw.root_nodes([r for top in np.unique(last) for r in ctw.root_rows(units[last == top], counts[last == top].astype(float))])
    want = {u: v for top in np.unique(last) for u, v in zip(units[last == top].view(np.int64).tolist(), ctw.gram_scores(units[last == top], counts[last == top].astype(float), root), strict=True)}
    grams = spark.createDataFrame(list(zip(units.view(np.int64).tolist(), counts.tolist(), strict=True)), "unit long, c long")
    got = {r["unit"]: r["value"] for r in ctw.gram_values(grams).collect()}
    assert set(got) == set(want) and all(abs(got[u] - want[u]) < 1e-9 for u in want)
    one = grams.where((F.shiftrightunsigned("unit", 8 * ctw.DEPTH)) == ord("a"))
    assert part > 300 or ctw.parted(one).select("part").distinct().count() > 1


def test_toxicity_learns_and_ignores_all_but_the_text(spark):
    clean, bad = [f"calm words about thing{i} and more of it" for i in range(60)], [f"you awful{i % 7} person{i} go away" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(clean + bad)] + [(500, None), (None, "calm words"), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(120)], "doc_id long, toxic int")
    got = [r.asDict() for r in toxicity.score(docs, labels).collect()]
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 120]
    assert np.mean([r["predicted"] == (r["doc_id"] >= 60) for r in held]) > 0.9


def test_toxicity_without_both_classes_rejects_nothing(docs, labels):
    only = labels.where("toxic = 0")
    assert {r["score"] for r in toxicity.score(docs, only).collect()} == {0.0}
    kept = toxicity.drop_toxic(docs, only)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


def test_repeated_passages(docs):
    got = {r["doc_id"]: r.asDict() for r in paragraphs.repeated_passages(docs).collect()}
    assert set(got) == {7, 9}
    assert (got[7]["start_word"], got[7]["n_words"], got[7]["first_doc_ids"], got[7]["component_id"]) == (33, 80, [6], 6)
    assert (got[9]["start_word"], got[9]["n_words"], got[9]["first_doc_ids"], got[9]["component_id"]) == (0, 6001, [8], 8)  # the line as a whole is near enough


def test_near_paragraphs_and_edited_copies(spark):
    words = [f"v{i}" for i in range(120)]
    edited = [*words[:60], "other", *words[61:]]
    few = [f"u{i}" for i in range(49)]
    rows = [(1, " ".join(words)), (2, "x\n" + " ".join(edited) + "\ny"), (3, " ".join(few)), (4, " ".join(few))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["start_word"], r["n_words"]) for r in paragraphs.repeated_passages(docs).collect()]
    assert got == [(2, 1, 120)]
    assert {r["doc_id"]: r["text"] for r in paragraphs.drop_repeats(docs).collect()} == {1: rows[0][1], 2: "x\ny", 3: rows[2][1], 4: rows[3][1]}


def test_near_lines_of_template_text_meet(spark):
    rng = np.random.default_rng(7)
    common = [f"t{i}" for i in range(200)]
    lines = []
    for own in range(60):  # 34 of every 40 words shared, each line with copies of 4 edits
        line = [w if i % 40 < 34 else f"o{own}x{i}" for i, w in enumerate(common)]
        lines.append(line)
        for copy in range(4):
            edited = list(line)
            for place in rng.choice(200, 4, replace=False):
                edited[place] = f"e{own}x{copy}x{place}"
            lines.append(edited)
    lines = [lines[i] for i in rng.permutation(len(lines))]
    rows = [(i, " ".join(line)) for i, line in enumerate(lines)]
    got = {r["doc_id"] for r in paragraphs.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("n_words >= 200").collect()}
    sets = [{tuple(x[i : i + 5]) for i in range(196)} for x in lines]
    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert got <= {a for a in range(300) if any(like(a, b) for b in range(a))}
    lost = [a for a in range(300) if a not in got and any(b not in got and like(a, b) for b in range(a))]
    assert not lost


def test_drop_repeats_keeps_rows_and_columns(docs):
    cut = paragraphs.drop_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    texts = {r["doc_id"]: r["text"] for r in cut.collect() if r["doc_id"] in (6, 7, 9)}
    assert texts == {6: ROWS[6][1], 7: f"a different one {' '.join(f'q{i}' for i in range(30))} ends otherwise", 9: ""}


def test_license_inheritance(spark):
    rows = [
        (1, "p/LICENSE", "Released under the MIT License."), (2, "p/a/b/x.c", "plain"), (3, "p/a/LICENSE.txt", "Licensed under CC BY-NC 4.0.\nmore"),
        (4, "p/a/b/y.c", None), (5, "q/z.c", ""), (6, "q/w.c", "text\nlicensed under the apache license, version 2.0"), (7, None, "no path"), (8, "p/m.c", "the is of version"),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["licence"], r["source"], r["licence_path"]) for r in license.scan(files).collect()}
    assert got == {
        1: ("MIT", "own", "p/LICENSE"), 2: ("CC-BY-NC-4.0", "inherited", "p/a/LICENSE.txt"), 3: ("CC-BY-NC-4.0", "own", "p/a/LICENSE.txt"),
        4: ("CC-BY-NC-4.0", "inherited", "p/a/LICENSE.txt"), 5: (None, "none", None), 6: ("Apache-2.0", "own", "q/w.c"), 7: (None, "none", None),
        8: ("MIT", "inherited", "p/LICENSE"),
    }


def test_license_terms_weigh_by_their_documents(spark):
    rows = [(i, f"d/{i}.txt", "and all of this is by the way") for i in range(300)] + [(300, "d/x.c", "by the way and all of this is released under the MIT License.")]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    assert [(r["doc_id"], r["licence"]) for r in license.scan(files).where("source = 'own'").collect()] == [(300, "MIT")]


def test_license_bodies_and_wrapped_headers(spark):
    whole = {name: license._whole(name) for name in license.WHOLE}
    rows = [(i, f"{name}/LICENSE", text.replace("<year> <copyright holders>", "2024 Jane Doe")) for i, (name, text) in enumerate(whole.items())]
    apache = [line.strip() for line in license.HEADERS["Apache-2.0"].split("\n")]
    gpl = [line.strip() for line in license.HEADERS["GPL-3.0"].split("\n")]
    code = "\n\nint main(void) { return answer(42); }\n" * 30
    rows += [(10, "s/a.py", "\n".join(f"# {x}" for x in ["Copyright 2024 Jane Doe", "", *apache]) + code)]
    rows += [(11, "s/b.c", "/*\n" + "\n\n".join(gpl) + "\n*/" + code), (12, "MIT/x.c", code), (13, "s/c.c", "// by Jane Doe" + code)]
    rows += [(20 + i, f"t/{i}.txt", "the use of this and that is by the way in any of the other texts") for i in range(50)]
    found = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["licence"], r["source"]) for r in license.scan(found).where("doc_id < 20").collect()}
    assert got == dict(enumerate((name, "own") for name in whole)) | {10: ("Apache-2.0", "own"), 11: ("GPL-3.0", "own"), 12: ("MIT", "inherited"), 13: (None, "none")}


def test_search_ties_and_empty_queries(docs):
    queries = docs.where("doc_id in (2, 3, 4)").dropDuplicates(["doc_id"]).selectExpr("doc_id as query_id", "text")
    got = [(r["query_id"], r["rank"], r["doc_id"]) for r in search.search(docs, queries, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(2, 1, 1), (2, 2, 2), (2, 3, 2)]


def test_search_takes_rows_of_one_query_id_together(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "a b", "c d", "d e f", "f"])], "doc_id long, text string")
    parts = spark.createDataFrame([(7, "a c"), (7, "c f"), (8, "zzz"), (None, "a")], "query_id long, text string")
    whole = spark.createDataFrame([(7, "a c c f")], "query_id long, text string")
    got, want = (sorted(map(tuple, search.search(docs, q).collect())) for q in (parts, whole))
    assert got == want and len(want) == 5


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, small, name):
    same, text = compare(spark, duck(small), small, name)
    assert same, text


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in REGISTRY} == {f"op{i}" for i in range(1, 14)}
    assert set(REGISTRY) | {"pipeline"} <= set(entry.queries())


def test_pipeline_stages(spark, small):
    docs = before = spark.read.parquet(f"{small}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).toArrow())
        assert docs.columns == before.columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic, good, single, cut = kept.values()
    assert set(toxic) >= set(good) >= set(single) == set(cut)
    prints = {i: plain_fingerprint(t) for i, t in good.items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert set(single) == set(brute_components(near, set(prints)).values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert {r["doc_id"] for r in packed.collect()} == set(cut)
