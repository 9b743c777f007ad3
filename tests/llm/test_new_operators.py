"""Vector codes, substring dedup and collocations against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.llm import blocks, collocations, queries, substring_dedup, vector_codes
from tests.conftest import SF

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_substring_dedup", "op13_collocations"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF).toPandas()
    want = con.sql(queries.oracle_sql()[name]).df()[list(got.columns)]
    both = [sorted(map(tuple, x.astype(str).to_numpy())) for x in (got, want)]
    assert len(got) and both[0] == both[1]


# vector codes


def plain_codes(kept, parts=16, entries=64, rounds=2):
    """(codes, errors, books) of integer rows in order of their ids, by measuring everything in every round."""
    width = -(-max(map(len, kept)) // parts) * parts
    v = np.array([list(x) + [0] * (width - len(x)) for x in kept], object).reshape(len(kept), parts, -1)
    books = v[:entries].copy()
    near = lambda p: np.array([((books[:, p] - x) ** 2).sum(axis=1).argmin() for x in v[:, p]])
    for _ in range(rounds):
        code = np.stack([near(p) for p in range(parts)], axis=1)
        for p in range(parts):
            for e in set(code[:, p].tolist()):
                own = v[code[:, p] == e, p]
                books[e, p] = [int(s) // len(own) for s in own.sum(axis=0)]
    code = np.stack([near(p) for p in range(parts)], axis=1)
    errors = [int(sum(((books[c[p], p] - x[p]) ** 2).sum() for p in range(parts))) for c, x in zip(code, v)]
    return ["".join(f"{e:02x}" for e in c) for c in code.tolist()], errors, ",".join(str(x) for p in range(parts) for e in range(len(books)) for x in books[e, p])


@pytest.mark.parametrize("n, dims, scale, block, safe", [(300, 32, 1.0, 64, 1 << 26), (40, 20, 1.0, 4096, 1 << 26), (90, 16, 1e5, 7, 1000), (1, 3, 1.0, 4096, 1 << 26)])
def test_codes_equal_plain_lloyd(spark, monkeypatch, n, dims, scale, block, safe):
    monkeypatch.setattr(vector_codes, "SAFE", safe)
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    monkeypatch.setattr(vector_codes, "CHUNK", 50)
    rng = random.Random(n)
    data = [(i * 3, [rng.choice([0.0, scale * rng.gauss(0, 1), -0.25]) for _ in range(dims - (i % 2))], rng.choice([None, 1, 2])) for i in range(n)]
    data += [(10_000 + i, [0.5 * scale] * dims, 7) for i in range(n // 3)]
    bad = [(-1, None, 1), (-2, [None] * dims, 1), (-3, [float("nan")] * dims, 1), (-4, [float("inf")] + [0.0] * (dims - 1), None)]
    rng.shuffle(data)
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<double>, label int").withColumns({c: F.col("vec_id") for c in ("v", "code", "error", "block", "n")})
    data.sort(key=lambda r: r[0])
    codes, errors, book = plain_codes([[int(np.floor(256 * x)) for x in v] for _, v, _ in data])
    of = Counter()
    for (_, _, label), e in zip(data, errors):
        of[label] += e
    digest = hashlib.sha256(book.encode()).hexdigest()
    want = [(i, c, e, of[label], digest) for (i, _, label), c, e in zip(data, codes, errors)]
    got = rows(vector_codes.coded_embeddings(df), "vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(got) == sorted(want)


def test_codes_of_nothing_nulls_and_repeats(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.coded_embeddings(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.coded_embeddings(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    got = rows(vector_codes.coded_embeddings(spark.createDataFrame([(None, [1.0] * 16, None), (5, [1.0] * 16, None), (5, [1.0] * 16, None), (6, [], 1)], schema)), "vec_id", "code", "error", "label_error")
    assert sorted(got, key=str) == sorted([(None, "00" * 16, 0, 0), (5, "00" * 16, 0, 0), (5, "00" * 16, 0, 0), (6, "02" * 16, 0, 0)], key=str)
    with pytest.raises(Exception, match="too large"):
        vector_codes.coded_embeddings(spark.createDataFrame([(1, [1e30] * 16, 1)], schema)).collect()


def test_heaps_pop_only_what_the_drift_violates():
    rng = np.random.default_rng(3)
    parts, entries = rng.integers(-500, 500, (4000, 4)), rng.integers(-500, 500, (64, 4))
    code, least, second = vector_codes.nearest_two(parts, entries)
    heap = vector_codes.Heaps([[] for _ in entries])
    heap.push(list(range(len(parts))), code, least, second, [0.0] * 64)
    heap = vector_codes.Heaps.of(heap.data(), 64)
    moved = entries + rng.integers(-3, 4, entries.shape)
    moves = np.sqrt(((moved - entries) ** 2).sum(axis=1))
    drift = (moves + moves.max()).tolist()
    popped = heap.pop(drift)
    now, _, _ = vector_codes.nearest_two(parts, moved)
    assert set(np.flatnonzero(now != code).tolist()) <= set(popped) and len(popped) < len(parts) / 3
    assert all(k > drift[e] for e, h in enumerate(heap.heaps) for k, _ in h)


# substring dedup


def plain_removal(docs, window=20):
    """[(doc_id, n_words, n_removed, kept)] of rows (doc_id, text)."""
    words = [WORDS.findall(t or "") for _, t in docs]
    doc = [2**70 if i is None else i for i, _ in docs]
    first, starts = {}, {}
    for i, w in enumerate(words):
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, 2**71), doc[i])
            starts.setdefault((i, key), s)
    out = []
    for i, w in enumerate(words):
        keys = [tuple(w[s : s + window]) for s in range(len(w) - window + 1)]
        gone = {s + j for s, key in enumerate(keys) if first[key] < doc[i] or starts[i, key] < s for j in range(window)}
        out.append((docs[i][0], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def repeated_texts(rng, n):
    passage = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.choice([19, 20, 21, 45, 80]))) for _ in range(6)]
    out = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(5)):
            text.append(rng.choice([rng.choice(passage), " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(40))), "a " * rng.randrange(60), "a b " * rng.randrange(40), "x y x z " * rng.randrange(20)]))
        out.append((i, "\t".join(text)))
    return out


@pytest.mark.parametrize("rounds, window", [(0, 20), (1, 20), (2, 20), (4, 20), (2, 5), (3, 1), (3, 60)])
def test_removal_equals_brute_force(spark, docs_of, monkeypatch, rounds, window):
    monkeypatch.setattr(substring_dedup, "BLOCK_CHARS", 3000)
    rng = random.Random(rounds + window)
    docs = repeated_texts(rng, 120)
    docs += [(500, docs[5][1]), (500, docs[5][1]), (None, docs[5][1]), (None, docs[7][1]), (501, None), (502, ""), (503, " \n "), (-4, docs[9][1])]
    rng.shuffle(docs)
    got = rows(substring_dedup.without_repeats(docs_of(docs).repartition(3), window, rounds), "doc_id", "n_words", "n_removed", "kept")
    assert sorted(got, key=str) == plain_removal(docs, window)


def test_removal_of_long_texts_spans_and_nothing(spark, docs_of, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LONG", 100)
    monkeypatch.setattr(substring_dedup, "CHUNK", 7)
    docs = [(1, "q " * 5000), (2, " ".join(f"naïve{i} x\x1fy" for i in range(300))), (3, " ".join(f"naïve{i} x\x1fy" for i in range(100, 160)))]
    got = rows(substring_dedup.without_repeats(docs_of(docs)), "doc_id", "n_words", "n_removed", "kept", "removed")
    assert sorted(g[:4] for g in got) == plain_removal(docs)
    assert {g[0]: [tuple(x) for x in g[4]] for g in got} == {1: [(1, 5000)], 2: [], 3: [(0, 60)]}
    assert substring_dedup.without_repeats(docs_of(docs).limit(0)).count() == 0
    assert rows(substring_dedup.without_repeats(docs_of([(1, None)])), "doc_id", "n_words", "n_removed", "kept") == [(1, 0, 0, "")]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 25))
def test_windows_over_what_occurs_once_occur_once(seed, window):
    """Rounds never lose a window that repeats, whatever its texts."""
    rng = random.Random(seed)
    texts = [[int(x[1:]) if x[0] == "w" else hash(x) % 50 for x in (t or "").split()] for _, t in repeated_texts(rng, 12)]
    counts = np.array(list(map(len, texts)), "int64")
    flat = np.array([w for t in texts for w in t], "int64")
    _, places, n = np.unique(flat, return_inverse=True, return_counts=True)
    s = substring_dedup._begin({"n_words": blocks.pack(counts), "places": blocks.pack(places.astype("int32"))}, np.where(n > 1, (np.arange(len(n)) + 1) << 3, 0), window)
    for r in range(1, 5):
        s.prune()
        left, right = s.rewrite(r)
        fresh = (right > 0) | ((left & 63) > 1)
        keys = list(zip(left[fresh].tolist(), right[fresh].tolist()))
        count = Counter(keys)
        number = {k: i + 1 for i, k in enumerate(count)}
        s.names[fresh] = [(number[k] << 3) | r if count[k] > 1 else 0 for k in keys]
    s.prune()
    begins = np.cumsum(counts + 1) - (counts + 1)
    seen = Counter(tuple(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
    for b, t in zip(begins.tolist(), texts):
        assert not any(s.dead[b + i] for i in range(len(t) - window + 1) if seen[tuple(t[i : i + window])] > 1)


# collocations


def plain_collocations(docs, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f[lang or "und"].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        longest = Counter()
        for p, a in counts.items():
            if a >= least:
                for k in range(2, len(p)):
                    for i in range(len(p) - k + 1):
                        longest[p[i : i + k]] = max(longest[p[i : i + k]], a)
        found = []
        for p, a in counts.items():
            if a >= least and len(p) > 1 and 100 * longest[p] < 80 * a:
                score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("common", [64, 10**9, 4])
def test_collocations_equal_brute_force(spark, docs_of, monkeypatch, common):
    monkeypatch.setattr(collocations, "BLOCK_CHARS", 4000)
    monkeypatch.setattr(collocations, "COMMON", common)
    rng = random.Random(1)
    pool = ["the", "The", "of", "naïve", "日本", "x y", "hot", *(f"w{i}" for i in range(12))]
    texts = [" ".join(rng.choices(pool, [20, 5, 9] + [1] * (len(pool) - 3), k=rng.randrange(80))).replace(" w3 ", rng.choice([". ", ",", " w3\n", "\t w3 "])) for _ in range(200)]
    texts += ["a very common line, a very common line"] * 150 + [None, "", " . , ", "ha ha ha ha ha ha " * 20, "rare words here"]
    docs = [(i, t, rng.choice(["en", "en", "de", None])) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    got = rows(collocations.collocations(docs_of(docs).repartition(3), least=8, top=60), "lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(got) == plain_collocations([d[1:] for d in docs], 8, 60)


def test_collocations_of_long_texts_and_nothing(spark, docs_of, monkeypatch):
    monkeypatch.setattr(collocations, "LONG", 50)
    monkeypatch.setattr(collocations, "CHUNK", 5)
    docs = [(1, "one two three. " * 200 + "ONE two\r\n" * 3, "en"), (2, "one two three" + " one two" * 70, "en")]
    got = rows(collocations.collocations(docs_of(docs)), "lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert got and sorted(got) == plain_collocations([d[1:] for d in docs], 30, 2000)
    assert collocations.collocations(docs_of(docs).limit(0)).count() == 0
    assert collocations.collocations(docs_of([(1, "few words", "en"), (2, None, None)])).count() == 0


def test_scores_beyond_64_bits(spark):
    a, both = 2**52, 2**53
    got = spark.sql(f"SELECT (cast(2000000 as decimal(10,0)) * cast({a} as decimal(20,0))) div (cast({a} as decimal(20,0)) + cast({both} as decimal(20,0))) AS s").first().s
    assert got == 2_000_000 * a // (a + both)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=4), max_size=40), st.integers(1, 9))
def test_one_stack_counts_all_prefixes(suffixes, chunk):
    table = np.array(sorted(([*s, *[0] * (4 - len(s))] for s in suffixes), reverse=True), "int64").reshape(-1, 4)
    stack, got = collocations.PrefixStack(4), Counter()
    closed = [x for i in range(0, len(table), chunk) for x in stack.push(table[i : i + chunk], np.ones(len(table[i : i + chunk]), "int64"))] + list(stack.close())
    for p, f in closed:
        for prefix, n in zip(p.tolist(), f.tolist()):
            assert tuple(prefix) not in got
            got[tuple(prefix)] = n
    assert got == Counter(tuple(s[:k]) for s in suffixes for k in range(1, len(s) + 1))


# top-k shards


def test_trees_are_built_once_and_far_shards_stay_shut(spark):
    from framelake.llm import vector_search

    rng = np.random.default_rng(5)
    centres = rng.integers(-3000, 3000, (12, 8))
    v = np.concatenate([c + rng.integers(-40, 41, (400, 8)) for c in centres])
    rows_ = [(i, x.tolist(), i % 50 == 0) for i, x in enumerate(v)] + [(10_000 + i, v[0].tolist(), False) for i in range(900)]
    df = spark.createDataFrame(rows_, "id long, v array<long>, query boolean")
    shards = vector_search.dealt(df, 300, 8)
    sizes = {r["shard"]: r["count"] for r in shards.groupBy("shard").count().collect()}
    assert sum(sizes.values()) == len(rows_) and len(sizes) >= 12 and max(sizes.values()) < 500  # the repeated vector's leaf is cut
    trees = vector_search.built_trees(shards, 8, "float64")
    boxes = [(r["block"], vector_search.pickle.loads(r["data"])) for r in trees.where("bucket is not null").collect()]
    assert sorted(b for b, _ in boxes) == sorted(sizes)
    asked = shards.where("query").select("shard", "id", "v", F.lit(int((centres**2).sum(axis=1).min() * 0.8)).cast("long").alias("kth_score"), F.lit(0).cast("long").alias("kth_id"))
    opened = vector_search.routed(asked, boxes, 8, "float64").count()
    assert 0 < opened < 0.6 * asked.count() * (len(boxes) - 1)
    plan = vector_search.top_k(df.select(F.col("id").alias("vec_id"), "v"), F.col("vec_id") % 50 == 0, 5, 300)
    got = {}
    for r in plan.collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    ids = np.array([r[0] for r in rows_])
    m = np.array([r[1] for r in rows_])
    for q in [i for i in ids if i % 50 == 0]:
        scores = m @ m[np.flatnonzero(ids == q)[0]]
        want = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != q)[:5]
        assert sorted(got[q]) == want


def test_top_tree_keeps_equal_vectors_together():
    from framelake.llm import vector_search

    same = vector_search.TopTree(np.full((50, 3), 7), 8)
    assert same.leaves == 1 and (same.leaf_of(np.zeros((4, 3))) == 0).all()
    half = vector_search.TopTree(np.array([[0, 0]] * 30 + [[1, 5]] * 2 + [[2, 9]] * 3), 4)
    leaf = half.leaf_of(np.array([[0, 0], [1, 5], [2, 9], [-5, -5], [9, 99]]))
    assert half.leaves >= 2 and leaf[0] == leaf[3] and leaf[0] != leaf[2] and set(leaf.tolist()) <= set(range(half.leaves))
    assert vector_search.TopTree(np.zeros((0, 4)), 4).leaves == 1
