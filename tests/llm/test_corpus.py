import base64
import hashlib
import os
import random
import sys
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import plain  # noqa: E402
import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from plumbline.llm import bpe, exact, html_text, licences, minhash, mixing, packed, phrases, quality, queries, vectors  # noqa: E402
from plumbline.llm.common import connected, slices, split_words  # noqa: E402
from plumbline.session import shared_folder  # noqa: E402

SF = "/root/testdata/sf0.001"
rng = random.Random(5)


def prose(n, seed):
    own = random.Random(seed)
    return " ".join("".join(own.choice("abcdefghij") for _ in range(own.randint(1, 6))) for _ in range(n))


def mutated(text, share, seed):
    own, out = random.Random(seed), text.split()
    for _ in range(int(len(out) * share)):
        out[own.randrange(len(out))] = "x" * own.randint(1, 9)
    return " ".join(out)


BASE = prose(120, 1)
TEXTS = {
    0: None,
    1: "",
    2: " \t\n",
    3: "one two",
    4: "one  TWO",
    5: BASE,
    6: BASE,
    7: BASE.replace(" ", "\n", 3),
    **{10 + i: mutated(BASE, 0.01 * (i % 5), i) for i in range(25)},
    40: prose(30, 2) + " " + " ".join(BASE.split()[20:60]) + " " + prose(30, 3),
    41: " ".join(BASE.split()[50:90]),
    42: prose(12, 4),
    43: prose(12, 4),
    44: prose(13, 6),
    45: prose(13, 6) + " tail",
    46: prose(20000, 7),
    47: prose(20000, 7) + " end",
    48: "é́ 日本語 テキスト 🙂 <|endoftext|> 'll don't \x01 \x1c\x85 a",
    49: "a" * 5000,
}


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with columns whose names the operators use themselves."""
    rows = [(i, t, 1, "x", 0.5, True) for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, component long, keep_id string, score double, kept boolean").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def table_of(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select(*columns).collect()}


def test_words_split_on_ascii_space_only():
    ends, codes, distinct = split_words(pa.array([" a  B\t", None, "", "\x0b\x0cé\x85ü\x1cb "]), lower=True)
    assert [[distinct[c] for c in codes[a:b]] for a, b in zip(ends, ends[1:])] == [["a", "b"], [], [], ["é\x85ü\x1cb"]]
    batch = pa.RecordBatch.from_pydict({"t": ["aaaa", None, "bb", "cccccc"]})
    assert [s.num_rows for s in slices(batch, "t", 5)] == [2, 1, 1]
    texts = ["Ab Cé", "dÉ  F", "ÀB É", None, "xY Ez"]
    cut = pa.RecordBatch.from_pydict({"t": texts})
    for lower in (False, True):
        got = []
        for part in slices(cut, "t", 6):
            ends, codes, distinct = split_words(part.column("t"), lower)
            got += [[distinct[c] for c in codes[a:b]] for a, b in zip(ends, ends[1:])]
        plain_words = [(t or "").encode().lower() if lower else (t or "").encode() for t in texts]
        assert got == [[w.decode() for w in t.split()] for t in plain_words]


def test_components_chain_star_and_empty(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    found = connected(spark.createDataFrame(chain, "src long, dst long"))
    got = {r["id"]: r["component"] for r in found.collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert connected(spark.createDataFrame([], "src long, dst long")).count() == 0


# 1 ---------------------------------------------------------------------------


PAGE = (
    '<html><head><title>T &amp; x</title><script>var a="</p><article>";</script></head><body><header>Site</header><nav><a href="/">Home</a></nav>'
    '<div class="cookie-notice">We use cookies here</div><article><h1>A &lt;b&gt;\n title</h1><p>First   <b>bold</b>text.<br>line</p>'
    '<form><input>Join us</form><ul><li>one</li><li>two</li></ul><section id="comments"><p>nice!</p></section></article>'
    '<aside>More</aside><footer>&copy; me</footer></body></html>'
)


def test_main_text():
    weight = html_text.weights({})
    assert html_text.main_text(PAGE, weight) == "A <b> title\n\nFirst boldtext. line\n\none\n\ntwo"
    soup = '<div id="top">Home</div><div><h1>Title here</h1><p>Many words of the text stand here in a row.</p><p>And more.</p></div><div class="ads">Buy</div>'
    assert html_text.main_text(soup, html_text.weights({("div", False): 50, ("div", True): 1})).startswith("Title here\n\nMany words")
    for page in (None, "", "<nav>x</nav>", "<!-- only -->", "<script>never closed"):
        assert html_text.main_text(page, weight) == ""
    assert html_text.main_text("<aside>open <article><p>Body", weight) == "Body"
    assert html_text.main_text("<p title='a>b' " + "\"'" * 5000 + "<p>x", weight).endswith("x")
    assert html_text.region([-1.0, 2.0, -1.0, 2.0, -5.0, 3.0]) == (1, 4)
    assert html_text.region([-1.0]) == (0, 0)


def test_main_text_in_wrappers_named_like_boilerplate():
    weight, body = html_text.weights({}), "<p>Many words of the text stand here in a row.</p><p>And more of them.</p>"
    text = "Many words of the text stand here in a row.\n\nAnd more of them."
    for opening, closing in (
        ("<article class='post category-cookies'>", "</article>"),
        ("<div class='layout-sidebar-left'>", "</div>"),
        ("<div class='has-comments content'><div id='related-wrap'>", "</div></div>"),
        ("<form action='/'>", "</form>"),
        ("<main id='sidebar'><article class='reply'>", "</article></main>"),
    ):
        page = f"<html><body><nav>Home</nav>{opening}{body}<div class='ad'>Buy now</div>{closing}<footer>me</footer></body></html>"
        assert html_text.main_text(page, weight) == text
    comments = f"<article>{body}<ol class='comment-list'><li><article class='comment'><p>nice one</p></article></li></ol></article>"
    assert html_text.main_text(comments, weight) == text
    assert html_text.main_text(f"<div style='display:none' class='x'>{body}</div>", weight) == ""


def test_main_text_of_a_table(spark):
    rows = [(1, "u", PAGE, 9), (1, "u", PAGE, 9), (2, None, None, 9), (None, "v", "<p>plain</p>", 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = sorted(html_text.extract(pages).collect(), key=str)
    assert len(got) == 4 and {r["n_chars"] for r in got} == {len("plain"), 0, len("A <b> title\n\nFirst boldtext. line\n\none\n\ntwo")}
    assert html_text.extract(pages.where("false")).count() == 0


def test_main_text_matches_marked_articles(spark):
    import html
    import re

    found = table_of(queries.QUERIES["op1_main_text"](spark, SF), "page_id", "text", "n_chars")
    for row in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search("<article>(.*?)</article>", row["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", p)).split()) for p in re.split("</?(?:p|h1)>", inside)]
        want = "\n\n".join(p for p in parts if p)
        assert found[row["page_id"]] == (want, len(want))


# 2 ---------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [0, 1, 5, 15, 16, 33, 60, 64])
def test_simple_8b_round_trip(bits):
    own = np.random.default_rng(bits)
    for n in (0, 1, 2, 300, 3000):
        ids = own.integers(0, 2 ** min(bits, 63), n, dtype=np.uint64, endpoint=bits == 0) * np.uint64(1 + (bits == 64)) if bits else np.zeros(n, np.uint64)
        ids = np.where(own.random(n) < 0.5, ids, ids >> np.uint64(max(0, bits - 3)))
        ends = np.sort(np.append(own.integers(0, n + 1, 4), n))
        coded, counts = packed.pack(ids, ends)
        assert (packed.unpack(coded) == ids).all() and counts.sum() == len(coded)
        begin, word = 0, 0
        for end, count in zip(ends, counts):
            assert (packed.unpack(coded[word : word + count]) == ids[begin:end]).all()
            begin, word = end, word + count


def test_packed_files(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    folder = shared_folder(spark, "packed")
    packed.write(docs, folder, path, parts=4)
    got = table_of(packed.read(spark, folder).withColumn("crc", F.crc32("ids")), "doc_id", "start", "n_tokens", "crc")
    start = 0
    for i in sorted(TEXTS):
        ids = [*tokenizer.encode(TEXTS[i] or "", add_special_tokens=False).ids, 1]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    block = spark.read.parquet(folder).where("size(doc_ids) > 2").first().asDict()
    want = [*tokenizer.encode(TEXTS[block["doc_ids"][1]] or "", add_special_tokens=False).ids, 1]
    assert packed.read_document(block, 1).tolist() == want
    folder = shared_folder(spark, "packed")
    packed.write(empty, folder, path)
    assert packed.read(spark, folder).count() == 0


def test_ids_are_those_of_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, own = Tokenizer.from_file(path), random.Random(17)
    pieces = ["a", "It", "İ", "ς", "Σ", "é", "e\u0301", "\u0958", "ǅ", "ß", "9", "²", "'s", "'", "|", ".", "<", ">", "…", " ", "\n", "日", "🙂", "\u0307", "\x01", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof"]
    texts = ["".join(own.choices(pieces, k=own.randint(0, 14))) for _ in range(6000)] + [None, "İ|", "İ.", "İ<,", "x<|endoftext|>y"]
    with open(path, encoding="utf-8") as spec:
        encoder = packed.Encoder(spec.read())
    for start in range(0, len(texts), 700):
        part = texts[start : start + 700]
        ids, sizes = encoder.encode(pa.array(part, pa.string()))
        for text, found in zip(part, np.split(ids, np.cumsum(sizes)[:-1])):
            assert found.tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, packed.END_ID], text


# 3 ---------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    scored = queries.QUERIES["op3_quality"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 80 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in scored.collect())


def test_quality_edge_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, None) for i in TEXTS] + [(5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows) and rows[0]["component"] == 1
    assert quality.score(empty, model).count() == 0
    for marks in (labels.where("false"), labels.withColumn("quality", F.lit(1))):
        assert len({r["score"] for r in quality.score(docs, quality.fit(docs, marks)).collect()}) == 1


def test_quality_learns_an_interaction():
    own = np.random.default_rng(0)
    rows = own.random((2000, len(quality.FEATURES)))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.5)).astype(float)
    model = quality.train(rows, labels)
    assert ((model.logit(rows) > 0) == labels).mean() > 0.95 and (0, 1) in model.pairs


# 4 ---------------------------------------------------------------------------


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)
    own = np.random.default_rng(4)
    centre = own.normal(size=(6, 8))
    rows = [(i, (centre[i % 6] + own.normal(size=8) * 0.05 * (i % 4)).tolist(), i % 2) for i in range(200)]
    rows += [(200 + i, centre[0].tolist(), 0) for i in range(30)]
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, [float("inf")] + [1.0] * 7, 0), (304, [None, 1.0], 0)]
    rows += [(305, centre[0].tolist(), None), (306, [], 0), (307, centre[0, :4].tolist(), 0), (308, (centre[0] * 1e200).tolist(), 0)]
    got = table_of(
        vectors.groups(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, links int")),
        "vec_id", "n_links", "component_id", "kept",
    )
    good = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    links, counts = [], dict.fromkeys([r[0] for r in rows], 0)
    for n, (i, x, a) in enumerate(good):
        for j, y, b in good[:n]:
            x_, y_ = np.array(x) / max(map(abs, x)), np.array(y) / max(map(abs, y))
            if a == b and len(x) == len(y) and x_ @ y_ / np.linalg.norm(x_) / np.linalg.norm(y_) >= 0.98:
                links.append((i, j))
                counts[i] += 1
                counts[j] += 1
    least = plain.smallest_reachable([r[0] for r in rows], links)
    assert got == {i: (counts[i], least[i], least[i] == i) for i in counts} and max(counts.values()) > 20


def test_vectors_empty(spark):
    assert vectors.groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# 5 ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_perfect_hash_is_minimal(vocabulary):
    slots = vocabulary.hash.slots(bpe.word_hashes(vocabulary.tokens))
    assert sorted(slots.tolist()) == list(range(len(vocabulary.tokens)))


def test_byte_bpe(docs, empty, vocabulary):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = table_of(bpe.decode(bpe.encode(docs, vocabulary), vocabulary), "doc_id", "n_tokens", "ids", "decoded")
    for i, text in TEXTS.items():
        ids = other.encode_ordinary(text or "")
        assert got[i] == (len(ids), bytearray(np.array(ids, "<u4").tobytes()), bytearray((text or "").encode()))
    assert bpe.encode(empty, vocabulary).count() == 0
    assert table_of(bpe.round_trip(docs, vocabulary), "doc_id", "n_tokens", "ids", "decoded") == got


# 6 ---------------------------------------------------------------------------


def test_near_groups(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 4)
    monkeypatch.setattr(minhash, "LARGE", 3)
    sizes, least = plain.near_groups(TEXTS)
    got = table_of(minhash.groups(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert got == {i: (sizes[i], least[i], least[i] == i) for i in TEXTS}
    assert sum(least[i] != i for i in TEXTS) > 10
    assert minhash.groups(empty).count() == 0
    odd = spark.createDataFrame([(None, BASE), (None, BASE), (5, BASE), (5, BASE), (9, BASE)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.groups(odd).collect()), key=str)
    assert got == sorted([(None, None, False)] * 2 + [(5, 5, True)] * 2 + [(9, 5, False)], key=str)


def test_a_sketch_is_full_and_estimates():
    one = np.unique(np.random.default_rng(1).integers(0, 2**63, 600).astype(np.uint64))
    both = minhash.sketch([one[:500], one[100:600], one[:1], one[:3]])
    assert (both != minhash.EMPTY).all()
    assert abs((both[0] == both[1]).mean() - 4 / 6) < 0.2


def test_intersections_agree():
    own = np.random.default_rng(2)
    sets = [np.unique(own.integers(0, 50, 30).astype(np.uint64)) for _ in range(20)]
    i, j = (x.ravel() for x in np.indices((10, 10)))
    want = [len(np.intersect1d(sets[a], sets[10 + b])) for a, b in zip(i, j)]
    assert minhash._intersections(sets[:10], sets[10:], i, j).tolist() == want


# 7 ---------------------------------------------------------------------------


def test_licences(spark, docs, empty):
    rows = [
        (1, "Intro words here.\nReleased under the MIT license\nmore"),
        (2, "Some text. Licensed under the Apache License, Version 2.0. All rights reserved."),
        (3, licences.TEMPLATES[3][1].replace(". ", ".\n").replace("copy", "copies", 1)),
        (4, "licensed under CC BY-NC 4.0"),
        (5, None),
        (6, "the license of the rights of the version"),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, licences string")
    got = table_of(licences.scan(frame), "doc_id", "licences")
    assert [h["licence"] for h in got[1][0]] == ["MIT"] and {h["licence"] for h in got[2][0]} >= {"Apache-2.0", "Proprietary"}
    assert got[3][0][0]["licence"] == "MIT" and got[4][0][0]["licence"] == "CC-BY-NC-4.0" and got[5][0] == [] and got[6][0] == []
    for hits in got.values():
        for hit in hits[0]:
            best = max(plain.dice(plain.bag(hit["words"]), plain.bag(t)) for _, t in licences.TEMPLATES)
            assert abs(best - hit["score"]) < 1e-12 and best >= 0.8
    assert licences.scan(empty).count() == 0 and licences.scan(docs).where("size(licences) > 0").count() == 0


def test_licences_at_the_threshold(spark):
    texts = ["It is licensed under the MIT License.", "CC BY-SA 4.0", "Our work is licensed under CC BY-SA 4.0."]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = table_of(licences.scan(frame), "doc_id", "licences")
    assert [[(h["licence"], h["score"]) for h in got[i][0]] for i in range(3)] == [[("MIT", 0.8)], [("CC-BY-SA-4.0", 0.8)], [("CC-BY-SA-4.0", 0.8)]]
    for size in range(1, 300):
        fits = [n for n in range(1, 2 * size) if 2 * 10 * min(n, size) >= 8 * (n + size)]
        assert licences.whole_bounds(size, 0.8) == (fits[0], fits[-1])


def test_licences_wrapped_in_longer_documents(spark):
    long = [(name, text) for name, text in licences.TEMPLATES if len(text.split()) > 15]
    rows = [(len(long), "BSD", licences.TEMPLATES[13][1].replace("or without", "or without\n"))]
    rows += [(i, name, "\n".join(textwrap.wrap(text, 60))) for i, (name, text) in enumerate(long)]
    rows += [(len(long) + 1, "MIT", "We like it. " + "\n# ".join(textwrap.wrap(long[0][1], 40)) + " So it goes.")]
    rows += [(len(long) + 2, "MIT", "Ours is released under the\nMIT License. Read on.")]
    rows = [(i, name, f"{prose(200, i)}\n{text}\n{prose(200, i + 50)}") for i, name, text in rows]
    frame = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    got = table_of(licences.scan(frame), "doc_id", "licences")
    for i, name, _ in rows:
        best = got[i][0][0]
        assert best["licence"] == name and best["score"] >= 0.8
        assert abs(max(plain.dice(plain.bag(best["words"]), plain.bag(t)) for _, t in licences.TEMPLATES) - best["score"]) < 1e-12


def test_licence_scan_runs_no_python(spark):
    plan = queries.QUERIES["op7_licences"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


# 8 ---------------------------------------------------------------------------


@pytest.mark.parametrize("split", [2000, 2])
def test_repeats(docs, empty, monkeypatch, split):
    monkeypatch.setattr(phrases, "SPLIT_ROWS", split)
    got = table_of(phrases.remove_repeats(docs).withColumn("sha", F.sha2("kept_text", 256)), "doc_id", "n_words", "n_removed", "sha")
    assert got == plain.without_repeats(TEXTS)
    assert sum(r[1] for r in got.values()) > 1000
    assert phrases.remove_repeats(empty).count() == 0


def test_repeats_of_odd_ids(spark):
    odd = spark.createDataFrame([(None, BASE), (5, BASE), (5, BASE), (5, BASE + " x"), (9, BASE)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_removed"]) for r in phrases.remove_repeats(odd).collect()), key=str)
    assert got == sorted([(None, 0), (5, 0), (5, 0), (5, 0), (9, 120)], key=str)


def test_repeats_list_anchors_once_per_text(spark, monkeypatch):
    lists, keep = {}, phrases.stored

    def seen(df, name):
        lists[name] = keep(df, name)
        return lists[name]

    monkeypatch.setattr(phrases, "stored", seen)
    monkeypatch.setattr(phrases, "SHARD_ROWS", 2)
    rows = [(i, BASE) for i in range(30)] + [(40 + i, prose(20, i) + " " + " ".join(BASE.split()[:30])) for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = table_of(phrases.remove_repeats(frame).withColumn("sha", F.sha2("kept_text", 256)), "doc_id", "n_words", "n_removed", "sha")
    assert got == plain.without_repeats(dict(rows))
    found = lists["lists"].collect()
    assert len(found) == 7 and all(len(r["anchors"]) == len(set(r["anchors"])) < 20 for r in found)


# 9 ---------------------------------------------------------------------------


def test_rake_meets_its_margins():
    own = np.random.default_rng(9)
    tokens = own.integers(1, 1000, (5, 4, 3)).astype(float)
    tokens[0, 0] = 0
    margins = [own.dirichlet(np.ones(n)) for n in tokens.shape]
    found = mixing.rake(tokens, margins)
    for axis, want in enumerate(margins):
        assert np.allclose(found.sum(axis=tuple(a for a in range(3) if a != axis)), want, atol=1e-8)
    assert (found[tokens == 0] == 0).all() and not mixing.rake(np.zeros((2, 2)), margins[:2]).any()


def test_mixing(spark, docs, empty):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = mixing.sample(rows).toPandas()
    assert len(mixed) == rows.count() and (mixed["probability"] <= 1).all()
    expected = mixed["probability"] * mixed["n_tokens"]
    for name, targets in mixing.TARGETS.items():
        share = expected.groupby(mixed[name]).sum() / expected.sum()
        assert all(abs(share[k] - v) < 1e-6 for k, v in targets.items())
    assert abs(mixed["kept"].mean() - mixed["probability"].mean()) < 0.06
    odd = docs.withColumns({"source": F.when(F.col("doc_id") > 5, "src1"), "lang": F.lit("xx"), "topic": F.lit(None).cast("string")})
    assert mixing.sample(odd).count() == len(TEXTS)
    assert mixing.sample(odd.where("false")).count() == 0


def test_mixing_repeats_scarce_cells(spark):
    rows = mixing.sample(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("doc_id", "source", "lang", "topic", "text", "n_tokens")
    scarce = rows.where("topic <> 'tabular'").union(rows.where("topic = 'tabular'").orderBy("doc_id").limit(2))
    frame = mixing.sample(scarce)
    mixed = frame.toPandas()
    total = mixed["n_tokens"].sum()
    assert mixed["weight"].max() > 10 and mixed["copies"].max() >= int(mixing.KEEP * mixed["weight"].max())
    assert abs((mixed["copies"] * mixed["n_tokens"]).sum() / total - mixing.KEEP) < 0.05
    drawn = (mixed["copies"] * mixed["n_tokens"]).groupby(mixed["topic"]).sum() / (mixed["copies"] * mixed["n_tokens"]).sum()
    assert abs(drawn["tabular"] - mixing.TARGETS["topic"]["tabular"]) < 0.01
    assert ((mixed["copies"] > 0) == mixed["kept"]).all() and mixing.repeated(frame).count() == mixed["copies"].sum()
    whole = mixing.sample(scarce, keep=1.0).toPandas()
    assert abs((whole["copies"] * whole["n_tokens"]).sum() / total - 1) < 0.1


# 10 --------------------------------------------------------------------------


def test_exact(docs, empty):
    want = {}
    for i in sorted(TEXTS):
        want.setdefault(plain.normalised(TEXTS[i]), []).append(i)
    got = table_of(exact.decide(docs, exact.DigestIndex(docs.sparkSession)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    for text, ids in want.items():
        for i in ids:
            assert got[i] == (ids[0], len(ids), i == ids[0], hashlib.sha256(text.encode()).hexdigest())
    kept = exact.dedup(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(ids[0] for ids in want.values()) and kept.columns == docs.columns
    assert exact.dedup(empty).count() == 0


def test_index_persists_over_batches(spark, docs):
    first = exact.DigestIndex(spark)
    before = exact.dedup(docs.where("doc_id < 20"), first).count()
    size = first.rows().count()
    again = exact.DigestIndex(spark, first.path)
    assert again.rows().count() == size == before
    assert exact.dedup(docs.where("doc_id < 20"), again).count() == before and again.rows().count() == size
    late = {r["doc_id"] for r in exact.dedup(docs.where("doc_id >= 20"), again).collect()}
    assert late == {i for i in TEXTS if i >= 20 and all(plain.normalised(TEXTS[j]) != plain.normalised(TEXTS[i]) for j in TEXTS if j < i)}
    join = spark.range(9).selectExpr("unhex(sha2(string(id), 256)) AS digest").hint("merge").join(again.rows(), "digest", "left_anti")
    assert "SortMergeJoin" in join._jdf.queryExecution().executedPlan().toString()


# pipeline --------------------------------------------------------------------


def test_pipeline_against_plain_stages(spark, vocabulary):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score(docs, model).where("predicted = 1").collect()}
    seen = {}
    for i in sorted(good):
        seen.setdefault(plain.normalised(texts[i]), i)
    left = set(seen.values())
    _, least = plain.near_groups({i: texts[i] for i in left})
    left = {i for i in left if least[i] == i}
    mixed = mixing.sample(docs.where(F.col("doc_id").isin(sorted(left))))
    left = {r["doc_id"] for r in mixed.where("kept").collect()}
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(found) == left and len(left) > 10
    for i, row in found.items():
        assert np.frombuffer(row["ids"], "<u4").tolist() == vocabulary.encode([texts[i] or ""])[0].tolist()
        assert row["decoded_sha256"] == hashlib.sha256((texts[i] or "").encode()).hexdigest()


def test_stages_keep_columns_of_odd_tables(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, BASE, "en", "src1", 3), (2, BASE, "en", "zz", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, SF)
            assert frame.columns == docs.columns
        frame.collect()


def test_packed_pieces_are_small():
    texts = [prose(200, i) * 20 for i in range(200)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": texts})
    pieces = list(slices(batch, "text", packed.PIECE_BYTES))
    assert sum(p.num_rows for p in pieces) == 200 and len(pieces) > 2
    assert max(sum(map(len, p.column("text").to_pylist())) for p in pieces) <= 1 << 20


def test_packed_encoder_learns_a_word_once_whatever_mark_follows(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as spec:
        encoder, tokenizer = packed.Encoder(spec.read()), Tokenizer.from_file(path)
    monkeypatch.setattr(packed, "REMEMBERED", 20)
    monkeypatch.setattr(packed, "RECENT", 1)
    marked = ["stökeit%%% Stökeit*** stökeit", "stökeit, (stökeit). стол. стол"]
    for k in range(4):
        texts = [*marked, prose(30, k), None, "İ. x's 9.a"]
        ids, sizes = encoder.encode(pa.array(texts, pa.string()))
        for text, found in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
            assert found.tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, packed.END_ID]
        assert {w for w in encoder.known if "stökeit" in w} == {"stökeit", "(stökeit"}
        assert len(encoder.known) == len(encoder.lengths) == len(encoder.starts) == len(encoder.met) < 80


def test_passages_are_named_and_cut_without_numbering_words(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["a  b\tc", None, " \n"]})
    (named,) = phrases._names(iter([batch]))
    assert named.column("n_words").to_pylist() == [3, 0, 0]
    assert named.column("digest")[1] == named.column("digest")[2] != named.column("digest")[0]

    def numbered(*_):
        raise AssertionError("words are numbered")

    monkeypatch.setattr(phrases, "split_words", numbered)
    assert next(phrases._names(iter([batch]))).equals(named)
    runs = [[{"seq": named.column("seq")[0].as_py(), "at": 1, "stop": 2}, {"seq": 0, "at": 0, "stop": 1}], None, []]
    (cut,) = phrases._cut(iter([batch.append_column("runs", pa.array(runs))]))
    assert cut.select(["n_words", "n_removed", "kept_text"]).to_pylist() == [
        {"n_words": 3, "n_removed": 1, "kept_text": "a c"},
        {"n_words": 0, "n_removed": 0, "kept_text": ""},
        {"n_words": 0, "n_removed": 0, "kept_text": ""},
    ]
