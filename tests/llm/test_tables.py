"""Operators over whole tables: near-duplicates, mix, nearest vectors, URL rules, pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from aerolith.llm import hnsw, mixing, simhash, url_filter
from aerolith.llm.queries import QUERIES, SITE_RULES, SQL
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_agree_with_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), SQL[name]) is None


def signed(x):
    return int(np.array([x], dtype=np.uint64).view(np.int64)[0])


def test_links_and_components(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    flips = lambda: np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)))
    fps = np.unique([*(b ^ flips() for b in base for _ in range(25)), *(np.uint64(5) ^ np.uint64(k) for k in range(400)), np.uint64(2**64 - 1)])
    near = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 2]
    want = {tuple(sorted((signed(fps[i]), signed(fps[j])))) for i, j in near}
    links = simhash.near_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"))
    assert {(r.a, r.b) for r in links.collect()} == want
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in want:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert dict(simhash.components(links).collect()) == {x: find(x) for ab in want for x in ab}


def test_a_long_chain_is_one_component(spark):
    order = list(range(60))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(min(p), max(p)) for p in zip(order, order[1:], strict=False)], "a long, b long")
    assert {r.root for r in simhash.components(links).collect()} == {0}


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long), (3, long + " end"), (9, None), (8, ""), (None, "  "), (7, "some other words here"), (None, "all alone in here"), (7, "some other words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    got = sorted(((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(docs).collect()))
    close = int(simhash.fingerprints_of([long.encode()])[0] ^ simhash.fingerprints_of([(long + " end").encode()])[0]).bit_count() <= 2
    assert got == sorted([(-1, -1), (-1, 8), (3, 3), (5, 3 if close else 5), (7, 7), (7, 7), (8, 8), (9, 8)])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == sorted([-1, 3, 7, 8] + ([] if close else [5]))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


def test_mix_keeps_to_its_budgets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs, range_rows=7).toPandas()
    total = rows["size"].sum()
    by = rows.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["taken"] == np.floor(by["target"])).all() and (rows["taken"] <= 2 * rows["size"]).all()
    assert abs(by["target"].sum() - 1.5 * total) < 1e-3 and (by["target"] <= 2 * by["size"] + 1e-9).all()
    assert rows.sort_values("doc_id").taken.tolist() == mixing.mix(docs.repartition(5), range_rows=50_000).toPandas().sort_values("doc_id").taken.tolist()


def test_mixed_documents(spark):
    rows = [(1, "a  b c\n", "x", 7), (2, "d e", "x", 3), (3, "f " * 40, "y", 80), (4, None, "y", 0), (5, " one\ttwo", None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumn("size", F.lit("clash"))
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    words = {}
    texts = {r[0]: r[1] for r in rows}
    for r in got.collect():
        assert r.text == texts[r.doc_id] or texts[r.doc_id].split()[: len(r.text.split())] == r.text.split() and r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {k: v for k, v in taken.items() if v}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0
    empty = docs.withColumn("text", F.lit(None).cast("string"))
    assert {r.taken for r in mixing.mix(empty).collect()} == {0}


def test_search_small_tables_exactly(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(60, 5)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(100 + i, vectors[0].tolist()) for i in range(40)]
    rows += [(200, None), (201, [0.0] * 5), (202, [float("nan")] + [1.0] * 4), (203, [float("inf")] + [1.0] * 4), (204, [None] + [1.0] * 4), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = {}
    for r in sorted(hnsw.search(df, 20, k=20, shard_rows=20).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    good = [(i, np.array(v, dtype=float)) for i, v in rows[:100]]
    for q, v in good:
        if q % 20 == 0:
            want = sorted((-round(float(v @ w), 9), i) for i, w in good if i != q)[:20]
            assert got.pop(q) == [(i, -s) for s, i in want]
    assert not got
    assert hnsw.search(df.limit(0), 20).count() == 0
    assert hnsw.search(df.filter("vec_id in (0, 1)"), 20).count() == 1


def test_graph_recall():
    x = np.random.default_rng(3).normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(np.hstack([x, np.zeros((len(x), 1))]))
    queries = np.hstack([x[:100], np.zeros((100, 1))])
    found, scores = graph.search(queries, 128)
    truth = np.argsort(-(x[:100] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b[:20])) / 20 for a, b in zip(truth.tolist(), found.tolist(), strict=True)]) > 0.95
    assert (np.diff(scores, axis=1) <= 0).all()


def brute_recall(spark, x, **settings):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = hnsw.search(df, 20, k=20, **settings).toPandas()
    hits = []
    for q in range(0, len(x), 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        rows = got[got["query_id"] == q]
        assert len(rows) == 20 and np.allclose(rows["score"], scores[rows["vec_id"]])
        hits.append(len(set(np.argsort(-scores)[:20]) & set(rows["vec_id"])) / 20)
    return np.mean(hits)


@pytest.mark.parametrize("outlier", [1e4, 1e-4, 1e150])
def test_recall_with_a_vector_of_extreme_length(spark, outlier):
    x = np.random.default_rng(11).normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= outlier
    assert brute_recall(spark, x) > 0.95


def test_recall_with_lengths_of_every_size(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4000, 32))
    x *= (np.exp(rng.normal(scale=3, size=len(x))) / np.linalg.norm(x, axis=1))[:, None]
    assert brute_recall(spark, x, shard_rows=2000) > 0.95


def test_bands_of_lengths():
    bands = hnsw._bands(np.array([1.0, 8.0, 4.0, 3.9, 0.0, 2.0, 0.0]))
    assert [b.tolist() for b in bands] == [[1, 2], [3, 5], [0], [4, 6]]


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.stack(table["embedding"].to_numpy()).astype(float)
    at = {v: i for i, v in enumerate(table["vec_id"])}
    got = QUERIES["op3_nearest_vectors"](spark, sf).toPandas()
    hits = total = 0
    for q, rows in got.groupby("query_id"):
        scores = x @ x[at[q]]
        scores[at[q]] = -np.inf
        hits += len(set(np.argsort(-scores)[:20]) & {at[v] for v in rows["vec_id"]})
        total += 20
        assert np.allclose(rows["score"], [x[at[v]] @ x[at[q]] for v in rows["vec_id"]])
    assert total == 20 * (table["vec_id"] % 20 == 0).sum() and hits / total > 0.95


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://com/", "http://example.com/en/x", "https://a.example.com/en/", "http://www.example.com/en/?q", "http://x.net/es/a", "http://net/fr/",
        "http://x.net/en/", "http://example.com/EN/", "HTTP://EXAMPLE.COM/en/#x", "http://example.com", "http://notexample.com/en/", "x://y?://example.com/en/", "http://a/b://net/es/",
        "http://free-casino.org/", "http://site.org/ads/1", "http://casino.net/es/", "http://x.net:80/es/", "http://x.net/es/\n", "http://sitecasinos.org/",
    ]
    rules = [url_filter.Rule(t, a, site=True) for t, a in SITE_RULES] + url_filter.pattern_rules()
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = {r.page_id: r for r in url_filter.filter_urls(df, rules).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else None
        host = path = ""
        if rest is not None:
            end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, tail = rest[:end], rest[end:]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
            path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        best = None
        for text, action in SITE_RULES:
            h, p = text[: text.index("/")], text[text.index("/") :]
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(text) > len(best[0])):
                best = (text, action)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, best and best[0]), url
        fits = [p.text for p in url_filter.pattern_rules() if url and url_filter.re.search(p.regex(), url, url_filter.re.S)]
        assert r.verdict == (best[1] if best else "block" if fits else "allow"), url
        assert r.pattern == (None if best or not fits else min(fits)), url
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0 and url_filter.filter_urls(df, []).count() == len(urls)


def test_hosts_of_every_kind_are_blocked(spark):
    families = ["casino-win", "cheap-pills", "free-bets", "spam-farm", "ads-track", "adult-x"]
    bad = [f"https://{sub}{f}.example.{top}/en/1" for f in families for sub in ("", "m.", "www.") for top in ("net", "org")]
    bad += ["HTTP://WWW.ADS-TRACK.Example.ORG", "http://me:pw@adult.example.org:80/", "http://x.org/ADS/1", "http://track.example.org/", "http://tracking?x", "http://a.best-porno"]
    good = ["http://broadcast.example.org/", "http://uploads.example.org/young-adult-books/", "http://roads-tracked.example.org/", "http://race-track.example.org/", "http://x.org/?u=http://ads.example.org/"]
    good += ["http://ads:pw@x.org/", "http://x.org/spam", "http://adults2.example.org/", "http://x.org/tracker-review#ads", "http://ſpam.example.org/"]
    rules = [url_filter.Rule(t, a, site=True) for t, a in SITE_RULES] + url_filter.pattern_rules()
    urls = [(i, u) for i, u in enumerate(bad + good)]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()}
    assert {u: got[i] for i, u in urls} == dict.fromkeys(bad, "block") | dict.fromkeys(good, "allow")
    assert len({p.text for p in url_filter.pattern_rules()}) == len(url_filter.pattern_rules())


def test_pages_of_bad_hosts_are_blocked_unless_a_site_rule_allows(spark):
    got = QUERIES["op1_url_filter"](spark, "/root/testdata/sf0.1").filter("rule is null and host rlike '(casino-win|cheap-pills|free-bets|spam-farm|ads-track|adult-x)'").collect()
    assert len(got) == 10 and {r.verdict for r in got} == {"block"}


def test_rules_are_filed_under_their_rarest_token():
    rules = [url_filter.Rule("/ads/banner/", "block"), url_filter.Rule("*x*", "block"), url_filter.Rule("example.com/en", "block", site=True)]
    filed, loose = url_filter.index_rules(rules, {"ads": 5, "banner": 2, "example": 1, "com": 9})
    assert filed == {"banner": [0], "example": [2]} and loose == [1]


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = []
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, step(spark, docs, SF)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
            docs = corpus_pipeline.stage(docs)
        sizes.append(docs.count())
        if name == "quality rules":
            kept = {r.doc_id for r in QUERIES["op7_quality_rules"](spark, SF).filter("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        if name == "SimHash near-dedup":
            groups = simhash.near_duplicates(before, most=corpus_pipeline.NEAR_BITS)
            assert docs.count() == groups.select("root").distinct().count()
            assert {r.doc_id for r in docs.collect()} == {r.component_id for r in groups.collect()}
        if name == "mixing sources":
            assert docs.select(F.sum(mixing.word_count())).first()[0] == mixing.mix(before).select(F.sum("taken")).first()[0]
    assert sizes[0] > 100 and sizes[3] == sizes[4]
    good = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").count()
    assert sizes[1] >= 0.9 * good * 200 / spark.read.parquet(f"{SF}/labels.parquet").count()
    assert corpus_pipeline.run(spark, SF).count() == sizes[4]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "SimHash near-dedup", "mixing sources", "SentencePiece"]


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, SF)
        assert out.count() == 0
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns


@pytest.mark.parametrize(("most", "crowd"), [(0, 4096), (1, 4096), (2, 4096), (2, 30), (3, 4096), (3, 10)])
def test_tallied_links_against_all_pairs(spark, most, crowd):
    rng = np.random.default_rng(most)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = {0, 2**64 - 1} | {int(b) for b in base}
    for b in base:
        for _ in range(60):
            fps.add(int(b) ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 5), replace=False)))
    fps |= {5 ^ (k << 20) for k in range(700)}  # one posting beyond all-pairs comparison
    fps = sorted(fps)
    want = {tuple(sorted((signed(fps[i]), signed(fps[j])))) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= most}
    links = simhash.near_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), most, crowd)
    got = [(r.a, r.b) for r in links.collect()]
    assert set(got) == want and (crowd < 4096 or len(got) == len(want))


@pytest.mark.parametrize("most", range(8))
def test_key_choices_meet_every_pair(most):
    from itertools import combinations

    choices = simhash.key_choices(most)
    assert all(any(not set(c) & set(hit) for c in choices) for hit in combinations(range(8), most))
    assert len(choices) == {0: 1, 1: 2, 2: 6, 3: 35}.get(most, len(choices))


def test_mix_spreads_rows_without_ids_and_many_ranges(spark, monkeypatch):
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one").alias("source"), F.concat(F.lit("a b c "), F.col("id").cast("string")).alias("text"))
    keys = docs.withColumn("size", F.lit(4)).select(mixing.document_key().alias("k")).distinct().count()
    assert keys == 2000
    plain = mixing.mix(docs, range_rows=7).agg(F.sum("taken")).first()[0]
    monkeypatch.setattr(mixing, "SPAN_RANGES", 10)
    spans = mixing.mix(docs, range_rows=7)
    assert spans.agg(F.sum("taken")).first()[0] == plain == 12_000
    assert sorted(r.taken for r in spans.collect()) == sorted(r.taken for r in mixing.mix(docs, range_rows=5000).collect())


def test_pipeline_stages_on_odd_rows(spark):
    """Null ids and texts, repeated rows, columns whose names the stages use: through all stages, by the stage's docstring."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    odd = docs.limit(6).withColumn("doc_id", F.lit(None).cast("long")).union(docs.limit(4)).union(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).union(docs.limit(1).withColumn("source", F.lit(None).cast("string")))
    docs = docs.union(odd)
    for c in ("kept", "llr", "lang_pred", "score", "bits", "fp", "root", "component_id", "_row", "_text", "size", "taken", "target"):
        docs = docs.withColumn(c, F.lit("clash"))
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        before, columns = docs, docs.columns
        docs = corpus_pipeline.stage(step(spark, docs, "/root/testdata/sf0.01"))
        assert docs.count() > 0
        if i < 4:
            assert docs.columns == columns and docs.filter("text IS NULL").count() == 0
        if i < 3:
            assert docs.exceptAll(before).count() == 0


def test_language_stage_rejects_what_was_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(3)
    foreign = ["A kutya a kertben szaladgál és ugat a macskára, aki a fán ül és nézi a madarakat, miközben az öregasszony a konyhában főzi az ebédet. " * 2]
    foreign += [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(2, 9))) for _ in range(50)), "1234 5678 --- 90"]
    planted = spark.createDataFrame([(10**9 + i, x, None, "web", len(x)) for i, x in enumerate(foreign)], docs.schema)
    kept = corpus_pipeline.language(spark, docs.union(planted), "")
    assert kept.filter("doc_id >= 1000000000").count() == 0
    clean = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1 and toxic = 0").select("doc_id")
    asked = docs.join(clean, "doc_id")
    assert kept.join(clean, "doc_id", "left_semi").count() >= 0.99 * asked.count()


def test_run_keeps_one_copy_of_its_stages(spark):
    import os

    from aerolith.session import shared_dir

    before = set(os.listdir(shared_dir(spark)))
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len(set(os.listdir(shared_dir(spark))) - before) <= 3  # the last stage's input, and what its plan still reads
