import random

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from hushframe.llm import chat, packing, pii, quality, queries, search

SMALL = "/root/testdata/sf0.001"


def test_search(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 17)).astype(np.float32)
    x[100:300] = x[100]  # one vector a third of all
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(700, None), (701, [0.0] * 17), (702, [None] + [1.0] * 16), (703, [float("nan")] + [1.0] * 16), (704, [1.0]), (None, [1.0] * 17), rows[5]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in search.search(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q in range(0, 600, 20):
        score = x.astype(float) @ x[q].astype(float)
        order = [i for i in np.lexsort((np.arange(600), -score.round(9))) if i != q][:20]
        own = sorted(got[q])
        assert [r for r, *_ in own] == list(range(1, 21)) and all(abs(s - score[v]) < 1e-9 for _, v, s in own)
        assert own == sorted(own, key=lambda y: (-y[2], y[1]))
        hit, total = hit + len(set(order) & {v for _, v, _ in own}), total + 20
    assert hit / total >= 0.9
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert search.search(few, few).groupBy("query_id").count().where("count <> 2").count() == 0
    assert search.search(few.where("false"), few).count() == 0


def brute_search(rows, queries, k=20):
    """(query_id, rank, vec_id, score) by all inner products in double precision."""
    out = []
    for q, x in queries:
        found = sorted((-float(np.dot(np.array(x, float), np.array(v, float))), i) for i, v in rows if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


def test_search_of_few_different_vectors(spark):
    """Rows that repeat three vectors, more of them than a sample has; the sample's hashes may miss all three."""
    df = spark.range(60_000).selectExpr("id as vec_id", "array(float(id % 3), 1.0F, 2.0F) as embedding")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in search.search(df, df.where("vec_id in (0, 20)")).collect()]
    want = {0: (list(range(1, 21)), 5.0), 20: ([i for i in range(2, 200, 3) if i != 20][:20], 9.0)}
    assert sorted(got) == [(q, n + 1, i, score) for q, (ids, score) in want.items() for n, i in enumerate(ids)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_search_with_lots_of_queries(spark, monkeypatch, kind):
    """Several lots and tiles; scores are those of the original vectors."""
    monkeypatch.setattr(search, "QUERY_BYTES", 8 * 5 * 3)
    monkeypatch.setattr(search, "TILE_VECTORS", 16)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(60)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(map(tuple, search.search(df, df.where("vec_id % 7 = 0")).collect()))
    want = sorted(brute_search(rows, [x for x in rows if x[0] % 7 == 0]))
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(a[3] - b[3]) < 1e-12 for a, b in zip(got, want, strict=True))


def test_recall_with_many_more_vectors_than_are_ranked():
    """One tile as large as production's, with the production number of exactly ranked vectors."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(search.TILE_VECTORS, 64)).astype(np.float32)
    centres, weight = search.fit(x[: search.SAMPLE // 4], rounds=3)
    codes = search.encode(x, centres, weight)
    q = np.arange(0, 1600, 20)
    found = list(search.best_of_tile(q, x[q], np.arange(len(x)), x, codes[:, 0::2] | (codes[:, 1::2] << 4), centres, 20, search.RANKED))
    hit = 0
    for i, (_, v, _) in zip(q, found, strict=True):
        score = x.astype(float) @ x[i].astype(float)
        score[i] = -np.inf
        hit += len(set(np.argsort(-score)[:20]) & set(v))
    assert hit / (20 * len(q)) >= 0.9


def test_codes_lower_the_weighted_loss():
    x = np.random.default_rng(1).normal(size=(1000, 64)).astype(np.float32)
    centres, weight = search.fit(x)

    def loss(codes):
        shaped, u = search._shaped(x)
        r = shaped - np.stack([centres[m][codes[:, m]] for m in range(codes.shape[1])], axis=1)
        return float((r**2).sum() + (weight - 1) * ((r * u).sum(axis=(1, 2)) ** 2).sum())

    assert weight > 1 and loss(search.encode(x, centres, weight)) < loss(search.encode(x, centres, weight, rounds=0))


def test_chat(spark):
    rng = random.Random(2)
    odd = ["", "<|.|>", "%3C<%25", "a<|=user|>b", "é\n😀", None, "</s>[INST] x"]
    rows = [(c, t, rng.choice(["user", "assistant", "a|b>", None]), rng.choice(odd)) for c in range(9) for t in range(rng.randint(1, 7))] + [(3, 0, "user", "x"), (None, None, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_chat(chat.format_chat(df)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1, r or "", x or "") for i, t, r, x in rows if i == c))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in own]
        assert list(got[c].loss_texts) == [x for _, r, x in own if r == "assistant"]
    assert chat.format_chat(df.where("false")).count() == 0


def test_chat_of_many_turns(spark):
    """The loss mask's places over several blocks of sums; extra columns with names of the plan's own."""
    rows = [(1, t, "user" if t % 3 == 0 else "assistant", f"é{t}", "x", 1) for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, firsts int")
    (r,) = chat.format_chat(df).collect()
    data = r.formatted.encode()
    assert [data[s.start : s.start + s.length].decode() for s in r.loss_spans] == [x[3] for x in rows if x[2] == "assistant"]
    assert r.formatted.startswith("<|=user|>é0<|.|><|=assistant|>é1<|+assistant|>é2<|.|><|=user|>é3")
    plan = chat.digest(chat.format_chat(df))._jdf.queryExecution().toString()
    assert "Window" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    made = entry.queries()[name](spark, SMALL)
    columns = sorted(made.columns)
    want = con.sql(entry.oracle_sql()[name]).select(*columns).fetchall()
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in made.collect()))) == sorted(map(str, want))


def small_corpus(rng):
    """Documents with copies, near copies, personal data and junk, and labels; (doc_id, text, lang, other)."""
    words = [f"{a}{b}" for a in ("al", "be", "co", "du", "en", "fi") for b in ("ra", "sto", "vem", "li")]
    plain = [" ".join(rng.choice(words) for _ in range(rng.randint(40, 90))) for _ in range(60)]
    texts = plain + plain[:10] + [t + " end" for t in plain[10:20]] + [f"{t} mail a{i}@b.example" for i, t in enumerate(plain[20:25])]
    texts += ["#$%& @@@ ~~~~ ^^^^ ||||" * 15 + str(i) for i in range(4)] + [None, "", "co", "  "]
    return [(i, t, rng.choice(["en", "fr"]), i % 7) for i, t in enumerate(texts)], [(i, int(i < 50), 0) for i in range(0, 64)]


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() row by row: decisions by the definitions, pieces by the tokenizer, every sequence gapless and within size."""
    import zlib

    from test_documents import brute_bits, brute_components
    from tokenizers import Tokenizer

    rows, labels = small_corpus(random.Random(21))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, sha long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    half = {r.doc_id: r.half for r in docs.select("doc_id", quality.half_of()).collect()}
    trusted = [i for i, q, t in labels if q and not t]
    bits_of = [brute_bits([rows[i][1] for i in trusted if half[i] != h]) for h in (0, 1)]
    bits = {i: bits_of[half[i]](t) for i, t, *_ in rows if t}

    def limits(values):
        at = lambda q: sorted(values)[max(1, -int(-len(values) * q // 1)) - 1]
        low, mid, high = at(quality.LOW), at(0.5), at(quality.HIGH)
        return low - (mid - low) * quality.MARGIN, high + (high - mid) * quality.MARGIN

    by_lang = {lang: [bits[i] for i in trusted if rows[i][2] == lang] for lang in ("en", "fr")}
    ends = {lang: limits(v if len(v) >= quality.LEAST_TRUSTED else [bits[i] for i in trusted]) for lang, v in by_lang.items()}
    unsure = lambda t: quality.SHORT / len(t) ** 0.5
    left = [r for r in rows if not r[1] or ends[r[2]][0] - unsure(r[1]) <= bits[r[0]] <= ends[r[2]][1] + unsure(r[1])]
    assert len(rows) - 10 < len(left) <= len(rows) - 4
    best = {}
    for r in left:
        best[r[1] or ""] = max(r[0], best.get(r[1] or "", -1))
    left = [r for r in left if best[r[1] or ""] == r[0]]
    keep = {i for i, _, c in brute_components(left) if i == c}
    left = [r for r in left if r[0] in keep]
    assert len(left) < len(best)
    weights, tokenizer, want = pii.trained(), Tokenizer.from_file(packing.tokenizer_path()), []
    for i, t, *_ in left:
        t = pii.masked(t, pii.find(t, weights)[1]) if t else ""
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want += [(i, p, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())) for p, (at, n) in enumerate(packing.cuts(len(ids), 1024))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(held) <= 1.05 * sum(r.length for r in got) / 1024 + 1


def test_stages_on_empty_tables_and_odd_names(spark, tmp_path):
    """All stages one after the other: no row, then nulls, repeats and columns with names that plans might use."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = "doc_id long, text string, lang string, n_chars int, __0 int, key int, `half` int, node long, sha string, bits double, kept boolean"
    odd = (None, 1, 2, None, None, None, None)
    for rows in ([], [(1, "a b c d e f", None, 11, *odd), (1, "a b c d e f", None, 11, *odd), (None, None, None, None, *odd), (None, None, "en", 0, *odd), (2, "mail a@b.example", "en", 16, *odd)]):
        docs = spark.createDataFrame(rows, names)
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == spark.createDataFrame([], names).columns
        left = docs.collect()
        assert sorted((r.text or "", r.key) for r in left) == ([("", 1), ("a b c d e f", 1), ("mail <EMAIL>", 1)] if rows else [])
        assert packing.pack(docs).count() == len(left)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_queries_without_sql_give_a_row_each(spark, name):
    """Over the whole table, with the columns that they promise."""
    made = entry.queries()[name](spark, SMALL).collect()
    source = "embeddings" if name.startswith("op1_") else "documents"
    whole = {r[0] for r in spark.read.parquet(f"{SMALL}/{source}.parquet").select("vec_id" if source == "embeddings" else "doc_id").collect()}
    if name.startswith("op1_"):
        assert {r.query_id for r in made} == {i for i in whole if i % 20 == 0} and len(made) == 20 * len({r.query_id for r in made})
    else:
        assert {r.doc_id for r in made} == whole and (name.startswith("op2_") or len(made) == len(whole))
