import hashlib

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from declgraph.llm import ann, chat, langid, pieces, simhash, substrings, tokens
from declgraph.llm.common import new_path


def removed(rows, window):
    seen, out = set(), Counter()
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            if k in seen:
                gone[a : a + window] = [True] * window
            seen.add(k)
        out[i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("window", "batches"), [(20, 1), (7, 4)])
def test_substring_dedup_equals_brute_force(docs, window, batches):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.text) for r in unique.select("doc_id", "text").collect() if r.text is not None) + [(r.doc_id, None) for r in unique.where("text is null").collect()]
    rows.sort(key=lambda r: r[0])
    got = Counter(map(tuple, substrings.substring_dedup(unique, window=window, gram=min(8, window - 2), batches=batches, fan_in=2, buckets=3).collect()))
    assert got == removed(rows, window)


def test_substring_dedup_takes_null_and_repeated_ids(docs):
    assert substrings.substring_dedup(docs).count() == docs.count()


@pytest.fixture(scope="session")
def tokenizer_json():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        return f.read()


HARD = ["", " ", "<|endoftext|> hi", "Don't x's. A.,B .. ,,a", "İstanbul İx \x1c Å. É, é.", "漢字,。", "a\n\n b", "▁x ▁", "  two  spaces ", "x" * 300]


def test_words_encode_as_whole_texts_do(tokenizer_json):
    encoder = tokens.Encoder(tokenizer_json)
    assert list(encoder.encode(HARD)) == [np.asarray(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in HARD]


def test_token_files_round_trip(spark, docs, tokenizer_json):
    path = new_path(spark, "t-ids")
    tokens.write_ids(docs, path, tokenizer_json, block_bytes=300, part_bytes=4000)
    got = tokens.read_ids(spark, path).collect()
    encoder = tokens.Encoder(tokenizer_json)
    want = Counter((r.doc_id, next(encoder.encode([r.text or ""])) + b"\x02\0\0\0") for r in docs.collect())
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    assert {r.doc_id for r in tokens.read_ids(spark, path, [3, 302]).collect()} == {3, 302}
    tokens.write_ids(docs.where("false"), new_path(spark, "t-none"), tokenizer_json)


def test_pieces_equal_the_library(spark, docs):
    model = pieces.model_bytes()
    coder = pieces.Coder(model)
    assert [coder.encode(t) for t in HARD] == [np.asarray(coder.sp.encode(t), "<u4").tobytes() for t in HARD]
    for giant, chunk in ((65536, 16384), (100, 40)):
        got = pieces.decode(pieces.encode(docs.where("length(text) < 30000 or text is null"), model, giant, chunk), model).collect()
        want = Counter((r.doc_id, np.asarray(coder.sp.encode(r.text or ""), "<u4").tobytes()) for r in docs.collect() if len(r.text or "") < 30000)
        assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
        assert all(r.sha == hashlib.sha256(r.decoded.encode()).hexdigest() for r in got)


def test_max_plus_product_is_associative():
    r = np.random.default_rng(0)
    m = [([(k, i) for i in range(4)], [(k + 1, i) for i in range(4)], np.where(r.random((4, 4)) < 0.5, r.random((4, 4)), -np.inf)) for k in range(3)]
    left, right = pieces.compose(pieces.compose(m[0], m[1]), m[2]), pieces.compose(m[0], pieces.compose(m[1], m[2]))
    assert np.allclose(left[2], right[2])


def test_multi_index_finds_neighbours(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(1500, 16)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, x[0].tolist()) for i in range(30)]
    bad = [(3000, None), (3100, [0.0] * 16), (3200, [float("nan")] * 16), (3300, [None] * 16), (3400, [1.0]), (None, x[1].tolist())]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = ann.nearest(frame, centroids=16, probe=0.6).collect()
    ids, m = np.asarray([i for i, _ in rows]), np.asarray([v for _, v in rows])
    right = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((m - m[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = [(int(ids[j])) for j in np.lexsort((ids, d))[:10]]
        mine = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert [g[0] for g in mine] == list(range(1, 11)) and all(g[2] == pytest.approx(float(d[ids == g[1]][0]), rel=1e-12) for g in mine)
        right, total = right + len({g[1] for g in mine} & set(want)), total + 10
    assert right / total >= 0.9
    exact = sorted((g.rank, g.vec_id) for g in ann.nearest(frame, centroids=4, probe=1.0).collect() if g.query_id == 0)
    assert [v for _, v in exact] == list(range(2000, 2010))
    assert ann.nearest(frame.where("false")).count() == 0


def test_language_model_on_held_out_rows(spark):
    de, en = "der die das und ist nicht ein schön für über", "the of and is not a with for over thing"
    rows = [(i, " ".join(np.random.default_rng(i).permutation((de if i % 2 else en).split())), "de" if i % 2 else "en", "h") for i in range(120)]
    frame = spark.createDataFrame(rows + [(900, None, None, None), (901, "", None, "h"), (902, "123 !!", None, "h")], "doc_id long, text string, lang string, source string")
    langs, logs = langid.train_on(frame.where("doc_id < 60"))
    got = {r.id: r for r in langid.identify(langid.document_evidence(frame), langs, logs).collect()}
    assert sum(got[i].lang == lang for i, _, lang, _ in rows if i >= 60) >= 59
    assert not any(got[i].accepted for i in (900, 901, 902))
    assert langid.drop_unidentified(spark.createDataFrame([], frame.schema), frame).count() == 0


def test_evidence_decides_where_the_text_does_not(spark):
    pages = [(i, f"http://a.de/de/{i}", "<html lang='de'><p>der die das und ist nicht</p>") for i in range(20)] + [(50, "http://a.de/de/x", "<html lang=de>x</html>"), (51, None, None)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    langs, logs = langid.train([("de", "der die das und ist nicht"), ("en", "the of and is not")])
    got = {r.id: r for r in langid.identify(langid.page_evidence(frame), langs, logs, markup=True).collect()}
    assert got[50].lang == "de" and got[50].confidence > 0.9 and not got[51].accepted


def test_preferences(spark):
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("assistant", "no")
    rows = [(1, [a, b], [a, c]), (2, [a, b], [a, b]), (3, None, [a]), (4, [], []), (5, [a, b, a], [a, b]), (6, [("user", None)], [("user", "")])]
    frame = spark.createDataFrame(rows, "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r.pair_id: r for r in chat.format_pairs(frame).collect()}
    show = lambda *t: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t)
    assert (got[1].n_prompt_turns, got[1].prompt, got[1].chosen, got[1].rejected) == (1, show(a), show(b), show(c))
    s = got[1].chosen_spans[0]
    assert got[1].chosen[s.start : s.end] == "yes<|im_end|>\n"
    assert got[2].chosen == got[2].rejected == "" and got[3].rejected == show(a) and got[4].prompt == "" and got[5].chosen == show(a) and got[5].chosen_spans == []
    assert got[6].n_prompt_turns == 1
    turns = spark.createDataFrame([(0, 0, "user", "x"), (0, None, None, None), (1, 0, "user", "x"), (None, 1, "a", "b"), (7, 0, "user", "y")], "conv_id long, turn long, role string, text string")
    assert {r.pair_id for r in chat.pair_up(turns).collect()} == {0, 3}


def test_similar_keeps_one_of_each_group(spark):
    r = np.random.default_rng(4)
    word = lambda: "".join(r.choice(list("abcdefgh"), 5))
    rows, groups = [], 30
    for g in range(groups):
        base = [word() for _ in range(200)]
        for k in range(4):
            w = list(base)
            w[int(r.integers(200))] = word()
            rows.append((g * 10 + k, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    path = new_path(spark, "similar")
    frame.write.parquet(path)
    assert sorted(x.doc_id for x in simhash.drop_near_copies(spark.read.parquet(path)).collect()) == [g * 10 for g in range(groups)]


def test_similar_equals_all_pairs_near_the_threshold(spark):
    """Chains of edits whose ends are not alike, short, empty and null texts, a repeated row: as all pairs would link them."""
    r = np.random.default_rng(11)
    word = lambda: "".join(r.choice(list("abcdefgh"), 5))
    rows = [(900, None), (901, ""), (902, "one two"), (903, "One  TWO"), (904, "one three"), (None, "one two"), (902, "one two")]
    for g in range(12):
        w = [word() for _ in range(120)]
        for k in range(6):
            rows.append((g * 10 + k, " ".join(w)))
            for at in r.integers(120, size=int(r.integers(1, 6))):
                w[int(at)] = word()
    for reordered in (rows, rows[::-1]):
        path = new_path(spark, "chains")
        spark.createDataFrame(reordered, "doc_id long, text string").write.parquet(path)
        got = sorted(x.doc_id for x in simhash.drop_near_copies(spark.read.parquet(path)).collect())
        assert got == plain_kept(rows)


def plain_kept(rows):
    """The ids that stay, by all pairs."""
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    sets, root = [simhash.shingle_set(t, 5) for _, t in order], list(range(len(order)))
    for i in range(len(order)):
        for j in range(i):
            if simhash.jaccard(sets[i], sets[j]) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return sorted(order[i][0] for i in range(len(order)) if root[i] == i)


def kept_of(spark, rows, name):
    path = new_path(spark, name)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    return sorted(x.doc_id for x in simhash.drop_near_copies(spark.read.parquet(path)).collect())


def test_alike_sets_share_a_shingle_of_their_prefixes():
    """Whatever the number of documents: pairs at 0.8 exactly, of 4 to 450 shingles, in any order of shingles."""
    r = np.random.default_rng(5)
    for n in (4, 8, 40, 400):
        for _ in range(200):
            common, a, b = np.split(r.integers(0, 2**63, n + 2 * (n // 8) + (n == 4), dtype=np.uint64), [n, n + n // 8 + (n == 4)])
            x, y = np.unique(np.r_[common, a]), np.unique(np.r_[common, b])
            assert simhash.jaccard(x, y) == 0.8
            often = np.unique(r.permutation(np.r_[common, a, b])[: n // 2])
            counts = r.integers(1, 9, len(often))
            assert len(np.intersect1d(simhash.prefix(x, 0.8, often, counts), simhash.prefix(y, 0.8, often, counts)))


def test_pairs_in_a_large_template_family_are_found(spark):
    """1,500 texts of one template that are not alike (0.786), and 60 pairs among them that are (0.818)."""
    r = np.random.default_rng(6)
    word = lambda: "".join(r.choice(list("abcdefgh"), 8))
    template, rows = [word() for _ in range(92)], []
    for g in range(1500):
        own = [word() for _ in range(12)]
        rows.append((2 * g, " ".join(template + own)))
        if g < 60:
            rows.append((2 * g + 1, " ".join(template + own[:2] + [word() for _ in range(10)])))
    sets = {i: set(simhash.shingle_set(t, 5).tolist()) for i, t in rows}
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
    assert all(alike(2 * g, 2 * g + 1) for g in range(60)) and not any(alike(0, 2 * g) or alike(1, 2 * g) for g in range(1, 1500))
    assert kept_of(spark, rows, "family") == [2 * g for g in range(1500)]


def test_short_pairs_at_the_threshold_are_found(spark):
    """4 shingles against 5, as sets 0.8 alike; the majorities of 4 and of 5 votes differ in many bits."""
    r = np.random.default_rng(7)
    rows = []
    for g in range(300):
        w = ["".join(r.choice(list("abcdefgh"), 8)) for _ in range(9)]
        rows += [(2 * g, " ".join(w[:8])), (2 * g + 1, " ".join(w))]
    assert kept_of(spark, rows, "short") == list(range(0, 600, 2))


def test_declared_language_after_a_long_start(spark):
    pages = [(0, "<!-- " + "licence " * 2000 + '--><html class="x" lang="de-AT"><p>a'), (1, "<!doctype html><HTML LANG='fr'>"), (2, '<html><p>&lt;x> <html lang="sv">'), (3, "no tag"), (4, None)]
    frame = spark.createDataFrame([(i, "http://a.b/c", h) for i, h in pages], "page_id long, url string, html string")
    assert {r.id: r.declared for r in langid.page_evidence(frame).collect()} == {0: "de", 1: "fr", 2: "", 3: "", 4: None}


def test_parities_of_all_lengths_bound_the_distance():
    rng = np.random.default_rng(3)
    sets = []
    for n in (0, 1, 40, 700, 1500, 1600, 5000, 40_000):
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64))
        sets += [base, np.unique(np.concatenate([base[: len(base) - len(base) // 10], rng.integers(0, 1 << 63, 9, dtype=np.int64).view(np.uint64)]))]
    short = [simhash.short_parity(simhash.parity(s)) for s in sets]
    assert sorted({len(s) * 8 for s in short}) == [512, 1024, 4096, 8192]
    held = simhash.Parities(short)
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    apart = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert held.near(i, j, apart).all()
    exact = np.array([simhash.parity_distance(short[a], short[b]) for a, b in zip(i, j)])
    assert held.near(i, j, exact).all() and not held.near(i, j, exact - 1).any()


def test_long_texts_that_share_passages_are_apart(spark, monkeypatch):
    """Long texts of several lengths that share 900 words, and one near copy of each, in several blocks a bucket, as all pairs link them."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(5)
    common = [f"c{x}" for x in rng.integers(0, 50_000, 900)]
    rows = []
    for k in range(24):
        own = [f"w{k}x{x}" for x in rng.integers(0, 50_000, 300 + 150 * (k % 12))]
        copy = own.copy()
        copy[len(copy) // 2] = "changed"
        rows += [(2 * k, " ".join(common + own)), (2 * k + 1, " ".join(common + copy))]
    assert kept_of(spark, rows, "long") == plain_kept(rows)
