"""The training-data operators against brute force, round trips and held-out accuracy; and their edge cases."""

import base64
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.llm import bpe, chat_format, langid, media, mixing, quality_lm, queries, simhash, token_counts, toxicity, vector_search
from framelake.sources import scratch
from tests.conftest import SF

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "Lorem ipsum <|endoftext|> dolor, " * 20_000
EDGES = [(1, None), (2, ""), (3, " \t\n "), (4, "a"), (5, LONG), (6, "naïve 日本語 🙂 x"), (6, "naïve 日本語 🙂 x"), (7, "same text here"), (8, "same text here"), (None, "no id"), (9, "<|endoftext|></s>[INST]\\<\\/s>")]
LABELS = "doc_id long, quality int, toxic int"


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# mixing


def shares(sizes, share=1.5, ceiling=2.0):
    """Targets by sharing the excess of full sources again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        for s in open_:
            target[s] += left * w[s] / total
        left = sum(max(0, target[s] - ceiling * sizes[s]) for s in open_)
        for s in list(open_):
            if target[s] >= ceiling * sizes[s]:
                target[s] = ceiling * sizes[s]
                open_.discard(s)
    return target


def test_targets_and_closeness(spark):
    got = queries.op1_mix_sources(spark, SF).join(table(spark, "documents").select("doc_id", "source", "text"), "doc_id").toPandas()
    assert (got["size"] == got["text"].map(lambda t: len(WORDS.findall(t)))).all()
    by = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"), given=("source_size", "first"))
    want = shares(by["size"].to_dict())
    assert (by["size"] == by["given"]).all() and all(by["target"][s] == pytest.approx(want[s]) for s in by.index)
    assert ((by["taken"] - by["target"]).abs() <= by["most"] / 2 + 1e-6).all()
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] % got["size"].clip(lower=1) == 0).all()


def test_mix_reruns_agree_over_partitions_and_levels(spark, docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    docs = docs_of([(i, "w " * (i % 7 + 1), "en", "ab"[i % 3 == 0]) for i in range(300)] + [(None, "x y", "en", None)] + EDGES)
    once = mixing.mix(mixing.sizes(docs)).toPandas()
    again = mixing.mix(mixing.sizes(docs.repartition(7))).toPandas()
    order = ["doc_id", "size", "source"]
    assert once.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))
    by = once.assign(taken=once["size"] * once["copies"]).groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((by["taken"] - by["target"]).abs() <= by["most"] / 2 + 1e-6).all()
    assert once[once["size"] == 0]["copies"].eq(0).all()


def test_mixed_documents_keep_columns(spark, docs_of):
    docs = docs_of(EDGES)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = mixing.mix(mixing.sizes(docs)).agg(F.sum("copies")).first()[0]
    assert mixed.count() == taken
    empty = docs.limit(0)
    assert mixing.mixed_documents(empty).count() == 0 and mixing.mix(mixing.sizes(empty)).count() == 0


def test_equal_rows_share_their_copies(spark, docs_of):
    docs = docs_of([(7, "w w w", "en", "a")] * 900 + [(7, "v w x", "en", "a")] * 10 + [(i, "w " * 5, "en", "b") for i in range(200)])
    mixed = mixing.mix(mixing.sizes(docs)).toPandas()
    by = mixed.assign(taken=mixed["size"] * mixed["copies"]).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"), n=("size", "count"))
    assert by["n"].to_dict() == {"a": 910, "b": 200} and ((by["taken"] - by["target"]).abs() <= by["most"] / 2 + 1e-6).all()
    once, again = (mixing.mixed_documents(d).groupBy("doc_id", "text").count().toPandas().sort_values(["doc_id", "text"]).reset_index(drop=True) for d in (docs, docs.repartition(5)))
    assert once.equals(again) and once[once["doc_id"] == 7]["count"].sum() == mixed[mixed["doc_id"] == 7]["copies"].sum()


def test_unlike_rows_of_a_unit_don_t_depend_on_partitions(spark, docs_of):
    docs = docs_of([(7, f"w{i} w w", "en", "a") for i in range(3000)] + [(7, "v w x", "en", "a")] * 2000 + [(i, "w " * 5, "en", "b") for i in range(200)])
    count = lambda n: {(r[0], r[1]): r[2] for r in mixing.mixed_documents(docs.repartition(n)).groupBy("doc_id", "text").count().collect()}
    once = count(3)
    assert once == count(8) and sum(v for (i, _), v in once.items() if i == 7) == sum(r["copies"] for r in mixing.mix(mixing.sizes(docs)).where("doc_id = 7").collect())


def test_pivot_keeps_mass_and_expectation():
    mass = np.array([5.0, 3, 8, 1, 9, 2])
    start = np.full(6, 0.3)
    ends = np.array([mixing.pivot(mass, start, seed) for seed in range(4000)])
    assert np.allclose(ends @ mass, start @ mass)
    assert ((ends > 0) & (ends < 1)).sum(axis=1).max() <= 1
    assert np.allclose(ends.mean(axis=0), 0.3, atol=0.03)


# token counts


def test_counts_equal_the_library(spark, docs_of):
    from tokenizers import Tokenizer

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        tok = Tokenizer.from_file(path)
        docs = docs_of(EDGES + [(20 + i, r["text"]) for i, r in enumerate(table(spark, "documents").limit(30).collect())])
        want = [(r["doc_id"], len((r["text"] or "").encode()), len(tok.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect()]
        assert sorted(rows(token_counts.count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens"), key=str) == sorted(want, key=str)


def test_cache_encodes_only_misses(spark, docs_of, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    first = docs_of(EDGES)
    token_counts.count_tokens(first, path, cache).count()
    assert spark.read.parquet(cache).count() == len({t or "" for _, t, *_ in EDGES})
    # wrong counts in the cache show that hits aren't encoded
    stored = spark.read.parquet(cache).toPandas()
    stored["n_tokens"] = 77
    spark.createDataFrame(stored, token_counts.CACHE).write.mode("overwrite").parquet(cache + "2")
    got = token_counts.count_tokens(docs_of([*EDGES, (50, "brand new")]), path, cache + "2").toPandas()
    assert set(got[got["doc_id"] != 50]["n_tokens"]) == {77} and got[got["doc_id"] == 50]["n_tokens"].item() == 2
    assert spark.read.parquet(cache + "2").count() == len(stored) + 1
    other = public_tokenizers.path("piece_bpe_32k.model")
    assert token_counts.count_tokens(first, other, cache + "2").where("n_tokens = 77").count() == 0
    assert token_counts.count_tokens(first.limit(0), path).count() == 0


# chat formatting

CONTROLS = st.text(alphabet=st.sampled_from(list("<>/s[]\\INSTROLE:AGMU ab\n")), max_size=40) | st.sampled_from(["</s>", "<\\/s>", "[INST]", "[ROLE]x[/ROLE]", "[IMAGE:0]", "\\", "<\\\\s>"])


@settings(max_examples=300, deadline=None)
@given(CONTROLS)
def test_escape_round_trip(text):
    escaped = re.sub(chat_format._ESCAPE, r"\1\2\\\3", text)
    assert chat_format.unescape(escaped) == text
    assert not re.search(r"[<\[]" + chat_format._TAILS, escaped)


def test_escape_in_spark_is_the_same(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\/s>", "a<s>b[AUDIO:1]", "\\", "$1 <", "[ROLE]</s>\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t"))).collect()
    assert all(chat_format.unescape(e) == t and e == re.sub(chat_format._ESCAPE, r"\1\2\\\3", t) for t, e in got)


def brute_chat(turns):
    want = {}
    for conv, turn, role, text in turns:
        want.setdefault(conv, []).append((turn if turn is not None else -1e18, role or "", text or ""))
    out = {}
    for conv, ts in want.items():
        ts.sort()
        h = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in ts).encode()).hexdigest()
        loss = "".join(t for _, r, t in ts if r == "assistant")
        out[conv] = (len(ts), h, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_query(spark):
    turns = [tuple(r) for r in table(spark, "conversations").select("conv_id", "turn", "role", "text").collect()] + [(-7, 0, "user", queries.CONTROL), (-7, 1, "assistant", queries.CONTROL)]
    got = {r[0]: tuple(r)[1:] for r in rows(queries.op3_chat_format(spark, SF), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")}
    assert got == brute_chat(turns)


def test_chat_edges_and_strings(spark):
    turns = [(1, None, None, None), (1, 0, "assistant", "x</s>🙂"), (1, 0, "assistant", "x</s>🙂"), (None, 3, "user", ""), (2, 5, "assistant", LONG), (1, 1, "ro]le<s>", "[INST]")]
    df = spark.createDataFrame([(*t, "junk") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat_format.format_conversations(df)
    got = {r[0]: tuple(r)[1:] for r in rows(chat_format.read_back(formatted), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")}
    assert got == brute_chat(turns)
    whole = {r["conv_id"]: r for r in chat_format.conversation_strings(formatted).collect()}
    s = whole[1]
    assert "".join(chat_format.unescape(s["formatted"][x["start"] : x["start"] + x["chars"]]) for x in s["loss_spans"]) == "x</s>🙂" * 2
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).count() == 0


def test_stored_turns_and_other_ids(spark, tmp_path):
    turns = [(f"c{i % 3}", i, "assistant" if i % 2 else "user", f"text {i}</s>") for i in range(3000)] + [(None, 1, "user", "x")]
    df = spark.createDataFrame(turns, "conv_id string, turn long, role string, text string")
    chat_format.format_conversations(df).repartition(7).write.parquet(f"{tmp_path}/turns")
    got = {r[0]: tuple(r)[1:] for r in rows(chat_format.read_back(spark.read.parquet(f"{tmp_path}/turns")), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")}
    assert got == brute_chat(turns)


def test_typed_parts(spark):
    part = "array<struct<type:string,text:string,ref:string,units:int>>"
    content = [("text", "see [IMAGE:0] ", None, None), ("image", None, "a.png", 2), None, ("video", None, "v", 1), ("audio", None, "b.wav", None), ("text", None, None, None), ("document", "x", "c.pdf", 3)]
    df = spark.createDataFrame([(1, 0, "assistant", content), (1, 1, "user", None)], f"conv_id long, turn long, role string, content {part}")
    r = chat_format.format_conversations(df, F.col("content")).orderBy("turn").collect()
    assert r[0]["formatted"] == "<s>[ROLE]assistant[/ROLE]see [\\IMAGE:0] [IMAGE:0][AUDIO:1][DOCUMENT:2]</s>\n"
    assert [(a["ordinal"], a["kind"], a["ref"], a["tokens"]) for a in r[0]["attachments"]] == [(0, "image", "a.png", 170), (1, "audio", "b.wav", 25), (2, "document", "c.pdf", 1500)]
    assert r[0]["expanded_tokens"] == 1695 and r[1]["expanded_tokens"] == 0 and r[1]["offset"] == len(r[0]["formatted"])


# quality


def brute_kneser_ney(train):
    """ln p(w | u, v) of interpolated modified Kneser-Ney, by counts in dictionaries."""
    from collections import Counter

    mark = "\U0010ffff" + "x"  # two begin marks that no text holds
    three = Counter((a, b, c) for t in train for a, b, c in zip((mark, mark, *t), (mark, *t), t))
    two = Counter((b, c) for _, b, c in three)
    one = Counter(c for _, c in two)

    def level(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2])
        off = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3])
        total, held = Counter(), Counter()
        for gram, k in counts.items():
            context = gram[:-1] if isinstance(gram, tuple) else ()
            total[context] += k
            held[context] += off[min(k, 3) - 1]
        left = lambda gram: max(0.0, counts[gram] - off[min(counts[gram], 3) - 1]) if gram in counts else 0.0
        return left, total, held

    (left3, total3, held3), (left2, total2, held2), (left1, total1, held1) = level(three), level(two), level(one)

    def log_p(u, v, w):
        p = left1(w) / total1[()] + held1[()] / total1[()] / (len(one) + 1)
        if (v,) in total2:
            p = left2((v, w)) / total2[(v,)] + held2[(v,)] / total2[(v,)] * p
        if (u, v) in total3:
            p = left3((u, v, w)) / total3[(u, v)] + held3[(u, v)] / total3[(u, v)] * p
        return np.log(p)

    return lambda t: float(np.exp(-np.mean([log_p(*g) for g in zip((mark, mark, *t), (mark, *t), t)]))) if t else None


@pytest.mark.parametrize(("block", "piece"), [(4 << 20, 1 << 20), (2000, 7)])
def test_perplexities_equal_brute_force(spark, docs_of, monkeypatch, block, piece):
    monkeypatch.setattr(quality_lm, "BLOCK_CHARS", block)
    monkeypatch.setattr(quality_lm, "SLICE", piece)
    texts = [r["text"] for r in table(spark, "documents").orderBy("doc_id").limit(60).collect()]
    train = texts[:20]
    model = quality_lm.train(docs_of(list(enumerate(train)), extra=False).select("text"))
    docs = docs_of([*EDGES, (40, "abba"), (41, "zzzz qq"), (42, "\U0001f642\U0001f642"), *[(100 + i, t) for i, t in enumerate(texts)]])
    got = sorted(((r["row"]["doc_id"], r["row"]["text"], r["perplexity"]) for r in quality_lm.with_perplexity(docs.repartition(3), model).collect()), key=str)
    perplexity = brute_kneser_ney(train)
    want = sorted(((r["doc_id"], r["text"], perplexity(r["text"])) for r in docs.collect()), key=str)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(a == b or a == pytest.approx(b, rel=1e-9) for (*_, a), (*_, b) in zip(got, want))
    total = sum(np.exp(-np.log(perplexity(c))) for c in {c for t in train for c in t}) + 1 / perplexity("\u4e00")
    assert total == pytest.approx(1)


@pytest.mark.parametrize(("sf", "junk"), [(SF, 0.3), ("/root/testdata/sf0.01", 0.1)])  # of SF's 11 junk texts each is a tenth
def test_quality_on_the_table(spark, sf, junk):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = queries.op4_quality(spark, sf).join(labels, "doc_id").toPandas()
    assert got[got["quality"] == 1]["keep"].mean() > 0.98
    assert got[got["quality"] == 0]["keep"].mean() < junk


def test_quality_limit_has_no_margin(spark):
    scored = spark.createDataFrame([("a", float(i)) for i in range(1, 1001)] + [("b", float(i)) for i in range(1, 21)], "lang string, judged double")
    assert quality_lm.thresholds(scored)[0] == {"a": 990.0, "b": 20.0}


def test_no_limit_comes_from_a_model_that_saw_its_texts(spark, docs_of):
    texts = [r["text"] for r in table(spark, "documents").where("text != ''").orderBy("doc_id").limit(40).collect()]
    docs = docs_of([(i, t, "en" if i % 4 else "fr") for i, t in enumerate(texts)] + [(100, texts[1]), (101, "qq zz")], extra=False)
    trusted = [i for i in range(40) if i % 3] + [100]
    labels = spark.createDataFrame([(i, int(i in trusted), 0) for i in [*range(40), 100]], LABELS)
    fold = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(quality_lm.FOLDS))).collect()}
    text = dict(enumerate(texts)) | {100: texts[1]}
    models = {f: brute_kneser_ney([text[i] for i in trusted if fold[i] != f]) for f in {fold[i] for i in trusted}}

    every = brute_kneser_ney([text[i] for i in trusted])
    entropy = sum(np.log(every(text[i])) * len(text[i]) for i in trusted) / sum(len(text[i]) for i in trusted)

    def drawn(i):
        n = len(text[i])
        return np.exp((np.log(models[fold[i]](text[i])) * n + quality_lm.PRIOR * entropy) / (n + quality_lm.PRIOR))

    got = {r["doc_id"]: r for r in quality_lm.score(docs, labels).collect()}
    for lang in ("en", "fr"):
        own = [i for i in trusted if got[i]["lang"] == lang]
        assert got[own[0]]["limit"] == pytest.approx(sorted(map(drawn, own))[int(np.ceil(0.99 * len(own))) - 1], rel=1e-9)
    assert fold[1] == fold[100] and got[1]["perplexity"] == got[100]["perplexity"]


def test_quality_models_are_made_together(spark, monkeypatch):
    """Each action and table of the driver's stays in its memory for a while; their number doesn't follow that of the folds."""
    written = []
    monkeypatch.setattr(quality_lm, "materialise", lambda df, name="table": written.append(name) or scratch.materialise(df, name))
    quality_lm.score(table(spark, "documents"), table(spark, "labels"))
    assert len(written) < 20 and len(set(written)) == len(written) - 1  # "known" of the trusted texts and of all


def test_a_block_of_a_model_holds_its_own_rows(spark, docs_of, monkeypatch):
    monkeypatch.setattr(quality_lm, "BLOCK_CHARS", 30)
    rows = [(i, "abcdefghij"[: i % 7] + "xyz"[i % 3]) for i in range(60)]
    docs = docs_of(rows, extra=False).withColumn("of", F.col("doc_id") % 3)
    found = quality_lm._gram_blocks(docs.repartition(2), "of").collect()
    held = {(r["block"], r["of"]): set(r["keys"]) for r in found if r["keys"] is not None}
    texts = {}
    for r in found:
        if r["row"] is not None:
            assert r["of"] == r["row"]["doc_id"] % 3
            texts.setdefault((r["block"], r["of"]), []).append(r["row"]["text"])
    assert sorted(t for own in texts.values() for t in own) == sorted(t for _, t in rows)
    assert held == {k: {int(g) for t in own for g in quality_lm.trigrams(t)} for k, own in texts.items()} and len({b for b, _ in held}) == len(held) > 6


def test_quality_edges(spark, docs_of):
    docs = docs_of(EDGES)
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (5, 0, 0), (7, 1, None), (None, 1, 1)], LABELS)
    got = {r["doc_id"]: r["keep"] for r in quality_lm.score(docs, labels).collect()}
    assert got[1] is False and got[2] is False and got[7] is True
    kept = quality_lm.kept_documents(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, v in got.items() if v}
    none = labels.limit(0)
    assert quality_lm.kept_documents(docs, none).count() == len([t for _, t in EDGES if t]) and quality_lm.score(docs.limit(0), none).count() == 0


# media


def brute_media(text):
    data = (text or "").encode()
    data = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
    return len((text or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])


def test_media_round_trip(spark, docs_of):
    got = rows(media.stored_texts(docs_of(EDGES)), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    assert sorted(got, key=str) == sorted([(i, *brute_media(t)) for i, t in EDGES], key=str)
    full = media.stored_texts(docs_of(EDGES)).toPandas()
    assert full[full["doc_id"].isin([7, 8])].drop(columns="doc_id").drop_duplicates().shape[0] == 1
    assert media.stored_texts(docs_of(EDGES).limit(0)).count() == 0


def test_media_columns(spark, docs_of):
    made = media.files_of(docs_of([(1, "x" * 5000), (2, None)], extra=False))
    broken = spark.createDataFrame([(3, bytearray(b"nothing like it")), (4, None), (5, bytearray(media.container(b"\0" * 6400)[:200])), (6, bytearray(b""))], "doc_id long, content binary")
    got = {r["doc_id"]: r for r in media.media_columns(made.unionByName(broken)).collect()}
    assert got[1]["codec"] == "raw " and got[1]["duration"] == 79 * 64 and got[1]["n_samples"] == 79 and len(got[1]["keyframes"]) == 5
    data = bytes(made.where("doc_id = 1").first()["content"])
    k = got[1]["keyframes"][1]
    assert data[k["offset"] : k["offset"] + k["bytes"]] == b"x" * 64
    assert all(got[i]["error"] for i in (3, 5, 6)) and got[4]["error"] is None and got[4]["codec"] is None


def test_media_of_two_tracks_fragments_and_hostile_files(spark):
    import struct

    box, full = media._box, lambda kind, *parts: media._box(kind, b"\0\0\0\0", *parts)

    def track(codec, stsz, stsc=((1, 2, 1),), offsets=(0,), extra=b""):
        stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(codec, b"\0" * 8)), full(b"stsz", stsz), full(b"stsc", struct.pack(">I", len(stsc)), *(struct.pack(">III", *r) for r in stsc)), full(b"stco", struct.pack(">I", len(offsets)), *(struct.pack(">I", o) for o in offsets)), extra)
        return box(b"trak", box(b"mdia", box(b"minf", stbl)))

    two = struct.pack(">IIII", 0, 2, 5, 7)
    deep = b""
    for _ in range(3000):
        deep = box(b"moov", deep)
    files = {
        1: box(b"moov", track(b"avc1", two), track(b"mp4a", two, offsets=(20,), extra=full(b"stss", struct.pack(">II", 1, 2)))) + box(b"mdat", b"x" * 100),
        2: box(b"moov", track(b"avc1", struct.pack(">II", 0, 0), offsets=())) + box(b"moof", b"\0" * 8),
        3: deep,
        4: box(b"moov", track(b"avc1", struct.pack(">II", 64, 2**32 - 1))),
        5: box(b"moov", track(b"avc1", two, extra=full(b"stss", struct.pack(">II", 1, 0)))) + box(b"mdat", b"x" * 100),
        6: box(b"moov", track(b"avc1", two, stsc=((1, 2**32 - 1, 1),))) + box(b"mdat", b"x" * 100),
        7: box(b"moov", track(b"avc1", two, stsc=((2, 1, 1), (1, 1, 1)))) + box(b"mdat", b"x" * 100),
        8: box(b"moov", track(b"avc1", two, extra=full(b"stts", struct.pack(">III", 1, 9, 1)))) + box(b"mdat", b"x" * 100),
    }
    df = spark.createDataFrame([(k, bytearray(v), "mine", 1) for k, v in files.items()], "doc_id long, content binary, codec string, error int")
    out = media.media_columns(df)
    got = {r["doc_id"]: r for r in out.collect()}
    assert [(t["codec"], [(k["offset"], k["bytes"]) for k in t["keyframes"]]) for t in got[1]["tracks"]] == [("avc1", [(0, 5), (5, 7)]), ("mp4a", [(25, 7)])]
    assert got[1]["codec"] == "avc1" and got[1]["file_codec"] == "mine" and got[1]["file_error"] == 1 and got[1]["error"] is None
    assert all(got[k]["error"] and got[k]["tracks"] is None for k in (2, 3, 4, 5, 7, 8)) and got[2]["error"] == "fragmented file"
    assert got[6]["n_samples"] == 2 and media.media_columns(df.limit(0)).count() == 0


def test_variable_sizes_and_large_boxes():
    import struct

    box = media._box
    stbl = box(b"stbl", box(b"stsz", b"\0" * 4, struct.pack(">IIIII", 0, 3, 5, 7, 9)), box(b"stsc", b"\0" * 4, struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)), box(b"co64", b"\0" * 4, struct.pack(">IQQ", 2, 100, 300)))
    inner = box(b"trak", box(b"mdia", box(b"minf", stbl)))
    moov = struct.pack(">I4sQ", 1, b"moov", 16 + len(inner)) + inner
    t = media.tracks(moov.ljust(400, b"\0")[: len(moov)] + box(b"free", b"\0" * 400))[0]
    assert media.ranges(t, np.arange(3)).tolist() == media.keyframes(t).tolist() == [[100, 5], [105, 7], [300, 9]]


def test_millions_of_small_samples_take_little_memory(spark):
    import struct
    import tracemalloc

    box, n = media._box, 20_000_000
    stbl = box(b"stbl", box(b"stsz", b"\0" * 4, struct.pack(">II", 1, n)), box(b"stsc", b"\0" * 4, struct.pack(">IIII", 1, 1, n // 2, 1)), box(b"stco", b"\0" * 4, struct.pack(">III", 2, 1000, 1000 + n // 2)))
    moov = box(b"moov", box(b"trak", box(b"mdia", box(b"minf", stbl))))
    data = moov + box(b"mdat", b"\0" * (n + 2000))
    tracemalloc.start()
    found, error = media.features(data)
    assert tracemalloc.get_traced_memory()[1] < 50e6 and error is None
    tracemalloc.stop()
    assert found[0]["n"] == found[0]["bytes"] == n and found[0]["keyframes"].tolist() == [[1000, n]]


# language identification


def test_language_held_out_accuracy(spark):
    got = queries.op6_language_id(spark, SF).join(table(spark, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3) == 1).all() and len(held) > 30
    assert (held["lang"] == held["lang_pred"]).mean() > 0.9
    assert got["score"].between(0, 1).all()


def test_many_languages_in_few_centres(spark, docs_of, monkeypatch):
    base = [(i, t * 3, lang) for i, (t, lang) in enumerate([("the cat and the dog ", "en"), ("der Hund und die Katze ", "de"), ("le chat et le chien ", "fr"), ("el gato y el perro ", "es")] * 12)]
    whole = langid.identify(docs_of(base)).toPandas().round({"score": 5})
    monkeypatch.setattr(langid, "CENTRES", 2)
    again = langid.identify(docs_of(base)).toPandas().round({"score": 5})
    assert again.sort_values("doc_id").reset_index(drop=True).equals(whole.sort_values("doc_id").reset_index(drop=True))
    assert set(whole["lang_pred"]) == {"en", "de", "fr", "es"}


def test_language_edges(spark, docs_of):
    base = [(100 + i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 12)]
    got = {r["doc_id"]: r for r in langid.identify(docs_of([*base, *EDGES, (200, "123 ..."), (201, "x", None)])).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 200))
    assert got[4]["lang_pred"] in ("en", "de") and len(got) == len({i for i, *_ in base + EDGES}) + 2
    assert langid.identify(docs_of(EDGES).limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs_of([(1, "abc", None)])).collect()} == {"und"}


# vector search


def brute_top(vectors, every=50, k=5):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(object)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % every == 0:
            scores = sorted(((int((v * w).sum()), -i) for i, w in ok if i != q), reverse=True)[:k]
            out += [(q, r + 1, -i, s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("shard", [4096, 64])
def test_top_k_equals_brute_force(spark, shard):
    rng = random.Random(5)
    rows_ = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, rng.random()]) for _ in range(6)]) for i in range(600)]
    rows_ += [(1000 + i, [0.25] * 6) for i in range(200)] + [(2000, None), (2050, [None] * 6), (2100, [float("nan")] * 6), (2150, [float("inf")] + [0.0] * 5), (2200, []), (None, [0.1] * 6)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows_], "vec_id long, embedding array<double>, score int, v int")
    v = df.select("vec_id", vector_search.quantised(F.col("embedding")).alias("v"))
    got = rows(vector_search.top_k(v, F.col("vec_id") % 50 == 0, 5, shard=shard), "query_id", "rank", "vec_id", "score")
    assert sorted(got) == brute_top(rows_)


def test_top_k_few_empty_and_large_values(spark):
    df = spark.createDataFrame([(0, [1e6, 1.0]), (50, [2e6, -1.0]), (7, [3.0, 4.0])], "vec_id long, embedding array<double>")
    got = rows(vector_search.search_embeddings(df), "query_id", "rank", "vec_id", "score")
    assert sorted(got) == brute_top([(0, [1e6, 1.0]), (50, [2e6, -1.0]), (7, [3.0, 4.0])])
    assert vector_search.search_embeddings(df.limit(0)).count() == 0


def test_top_k_of_unequal_lengths_and_beyond_a_long(spark):
    unequal = [(i, [1.0, 0.5 * i]) for i in range(1, 4)] + [(50, [5.0]), (100, [-1.0, 2.0, 3.0])]
    df = spark.createDataFrame(unequal, "vec_id long, embedding array<double>")
    padded = [(i, v + [0.0] * (3 - len(v))) for i, v in unequal]
    assert sorted(rows(vector_search.search_embeddings(df), "query_id", "rank", "vec_id", "score")) == brute_top(padded)
    large = [(0, [8e6, 1.0]), (50, [1.2e7, -1.0]), (7, [-8e6, 3.0])]  # the square of 50 is beyond a long
    df = spark.createDataFrame(large, "vec_id long, embedding array<double>")
    assert sorted(rows(vector_search.search_embeddings(df), "query_id", "rank", "vec_id", "score")) == brute_top(large)
    for beyond in ([(0, [1e16, 1e16]), (1, [1e16, 1e16])], [(0, [1e300]), (1, [1.0])]):
        with pytest.raises(Exception, match="long|[Oo]verflow|too large"):
            vector_search.search_embeddings(spark.createDataFrame(beyond, "vec_id long, embedding array<double>")).collect()


def test_tree_boxes_bound_their_rows():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-50, 50, (500, 8)).astype(float)
    tree = vector_search.Tree(np.arange(500), vectors, 16)
    q = rng.integers(-50, 50, (4, 8)).astype(float)
    bounds = tree.bounds(q)
    for n, (a, b) in enumerate(tree.span):
        assert (tree.vectors[a:b].min(axis=0) == tree.low[n]).all() and (tree.vectors[a:b].max(axis=0) == tree.high[n]).all()
        assert ((tree.vectors[a:b] @ q.T).max(axis=0) <= bounds[:, n] + 1e-9).all()


# byte-level BPE


@pytest.fixture(scope="module")
def coder():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_decodes(spark, docs_of, coder, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 20_000)
    monkeypatch.setattr(bpe, "LISTS", 2)
    docs = docs_of([*EDGES, *[(100 + i, r["text"]) for i, r in enumerate(table(spark, "documents").limit(60).collect())], *[(500 + i, "copy of it ") for i in range(300)]])
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    want = []
    for r in docs.collect():
        ids = coder.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = rows(bpe.encode(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(got, key=str) == sorted(want, key=str)
    back = bpe.decode(bpe.encode(docs, path, with_ids=True), path)
    texts = sorted(((r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()), key=str)
    assert sorted(((i, bytes(b)) for i, b in rows(back, "doc_id", "decoded")), key=str) == texts
    assert bpe.encode(docs.limit(0), path).count() == 0


# toxicity


def test_toxicity_finds_planted_words_and_spares_groups(spark, docs_of):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    rows_, labels = [], []
    for i in range(900):
        text = [word() for _ in range(rng.randint(5, 60))]
        toxic = i % 3 == 0
        if toxic:
            text.insert(rng.randint(0, len(text)), "xqz" + "h" + word())
        if rng.random() < (0.7 if toxic else 0.05):
            text.insert(0, "muslims")
        rows_.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    docs, labels = docs_of(rows_), spark.createDataFrame(labels, LABELS)
    got = toxicity.score(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["toxic"]).mean() > 0.97
    model = toxicity.fit(toxicity.labelled(docs, labels, "toxic", learn_fold=True))
    spared = toxicity.score_udf(model)
    probe = docs_of([(1, "muslims meet bacu"), (2, "christians meet bacu"), (3, "meet bacu")], extra=False)
    s = {r[0]: r[1] for r in probe.select("doc_id", spared(F.col("text"))).collect()}
    assert s[1] < 0.7 and abs(np.log(s[1] / (1 - s[1])) - np.log(s[2] / (1 - s[2]))) < 1.0


def test_rare_clear_words_outlast_frequent_ones(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CANDIDATES", 100, raising=False)
    common = " ".join(f"usual{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100))
    texts = [(i, f"{common} grubworm" if i % 10 == 0 else common, 1) for i in range(100)] + [(100 + i, common, 0) for i in range(400)]
    found = toxicity.fit(spark.createDataFrame(texts, "doc_id long, text string, label int"))["features"]
    assert "grubworm" in found and not any(f.startswith("usual") for f in found)


def test_counterfactual_penalty_flattens_a_weight():
    x = np.array([[1.0, 0], [1, 1], [0, 0], [0, 1]] * 50)
    y = np.array([1.0, 1, 0, 0] * 50)
    change = np.array([[1.0, 0.0]] * 10)
    free, _ = toxicity.fit_weights(x, y, change[:0])
    held, _ = toxicity.fit_weights(x, y, change, counterfactual=100.0)
    assert free[0] > 3 and abs(held[0]) < 0.1


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    held = queries.op9_toxicity(spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    toxic = held["toxic"] == 1
    assert len(held) > 100 and held[toxic]["predicted"].mean() >= 0.7 and held[~toxic]["predicted"].mean() <= 0.02


def test_toxicity_edges(spark, docs_of):
    docs = docs_of(EDGES)
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (7, None, None)], LABELS)
    got = toxicity.score(docs, labels).toPandas()
    assert len(got) == len(EDGES) and got["score"].between(0, 1).all() and got["score"].notna().all()
    assert toxicity.clean_documents(docs, labels).columns == docs.columns
    assert toxicity.clean_documents(docs, labels.limit(0)).count() == len(EDGES)
    assert toxicity.score(docs.limit(0), labels).count() == 0


# SimHash


def brute_print(text):
    import xxhash

    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(prints):
    ids, up = sorted(prints), {}

    def root(i):
        while up.get(i, i) != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_simhash_on_the_table(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, "documents").collect()}
    prints = {i: brute_print(t) for i, t in docs.items()}
    want = brute_groups(prints)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in queries.op10_simhash(spark, SF).collect()}
    assert got == {i: (prints[i], want[i]) for i in prints}


@pytest.mark.parametrize("piece", [4096, 16])
def test_links_connect_what_is_near(spark, monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    monkeypatch.setattr(simhash, "LEAF", 4)
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(20)] + [0, (1 << 64) - 1]
    prints = set(centres)
    for c in centres:
        x = c
        for _ in range(15):  # chains as well as stars
            x = (x if rng.random() < 0.5 else c) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            prints.add(x)
    signed = {p: (p ^ (1 << 63)) - (1 << 63) for p in prints}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.connected(simhash.links(df, len(signed))).collect()}
    named = brute_groups(dict(zip(signed.values(), signed)))
    groups: dict = {}
    for v in signed.values():
        groups.setdefault(named[v], set()).add(roots.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_contraction_ends_once_all_are_stars(spark, monkeypatch):
    from framelake.operators import graph

    written = []
    monkeypatch.setattr(graph, "materialise", lambda df, name="table": written.append(name) or scratch.materialise(df, name))
    found = lambda pairs: {r["node"]: r["root"] for r in graph.connected(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    assert found([(i, i % 3) for i in range(60)]) == {i: i % 3 for i in range(3, 60)} and written == ["edges"]
    mixed = random.Random(3).sample(range(300), 300)
    assert found([(a, b) for a, b in zip(mixed, mixed[1:]) if a % 50 and b % 50]) == _roots([(a, b) for a, b in zip(mixed, mixed[1:]) if a % 50 and b % 50])


def _roots(pairs):
    least = {x: x for p in pairs for x in p}
    for _ in pairs:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return {a: b for a, b in least.items() if a != b}



@pytest.mark.parametrize("n", [1, 3000, 10**6, 10**9, 10**13])
def test_masks_catch_every_three_flips(n):
    masks, rng = simhash.masks_for(n), random.Random(n)
    for _ in range(500):
        flips = sum(1 << b for b in rng.sample(range(64), 3))
        assert any((m % (1 << 64)) & flips == 0 for m in masks)
    assert all(n / 2 ** (m % (1 << 64)).bit_count() <= simhash.SHARD for m in masks)


def test_trees_leave_most_of_a_shard_out():
    rng = np.random.default_rng(11)
    values = rng.integers(0, 1 << 63, 2000, "uint64") * np.uint64(2)
    values[1000:1100] = values[:100] ^ np.uint64(6)
    tree, found = simhash.BKTree(values, np.arange(2000)), []
    took = tree.search(values, np.arange(2000), found)
    assert tree.leaf is None and all(((t.value if t.leaf is None else t.leaf[0]) ^ tree.value).bit_count() == d for d, t in tree.children.items())
    assert took < 0.5 * 2000 * 2000
    pairs = {(int(a), int(b)) for x, y in found for a, b in zip(x, y)}
    near = np.bitwise_count(values[:, None] ^ values) <= 3
    assert pairs == {(int(a), int(b)) for a, b in zip(*np.nonzero(near))}


def test_the_query_builds_trees(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prints = docs.select(simhash.fingerprint_udf(simhash.whole()).alias("fp")).distinct().toPandas()["fp"].to_numpy()
    assert simhash.masks_for(len(prints)) == [0] and len(prints) > 500  # one shard, and one tree over it
    values = prints.view("uint64")
    tree = simhash.BKTree(values, np.arange(len(values)))
    assert len(tree.children) > 10 and tree.search(values, np.arange(len(values)), []) < 0.5 * len(values) ** 2


def test_simhash_edges(spark, docs_of):
    docs = docs_of([*EDGES, (60, "Same TEXT here"), (61, None), (None, "another without"), (None, "another without")])
    got = simhash.components(docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(EDGES) + 4 and by[60]["component_id"] == 7 and by[61]["component_id"] == 1 and by[3]["fingerprint"] == "0" * 16
    kept = simhash.representatives(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(None) == 2 and len(ids) == len(set(ids)) + 1 and 8 not in ids and 60 not in ids and 7 in ids and None in ids
    assert simhash.components(docs.limit(0)).count() == 0


def test_an_id_with_unlike_texts_loses_none(spark, docs_of):
    docs = docs_of([(1, "one text of its own kind that stays here"), (1, "another and wholly different thing under this id"), (1, "One text of its own kind that stays here"), (2, "another and wholly different thing under this id")])
    got = [(r["doc_id"], r["text"].lower()) for r in simhash.representatives(docs).collect()]
    assert sorted(got) == [(1, "another and wholly different thing under this id"), (1, "one text of its own kind that stays here")]


def shingles_of(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("part", [512, 3])
def test_representatives_join_planted_near_copies(spark, docs_of, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part, raising=False)
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(words))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):  # a replaced word changes five shingles
            copy = list(words)
            for i in rng.sample(range(len(words)), max(1, round(share * len(words)))):
                copy[i] = f"new{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    sets = [shingles_of(t) for t in texts]
    jaccard = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(texts)) for j in range(i) if i // 6 == j // 6}
    root = list(range(len(texts)))
    for (i, j), s in sorted(jaccard.items()):
        if s >= 0.8:
            root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert sum(0.8 <= s < 0.95 for s in jaccard.values()) > 50 and any(s < 0.8 for s in jaccard.values())
    got = {r["doc_id"] for r in simhash.representatives(docs_of(list(enumerate(texts)))).collect()}
    assert got == set(root)


def test_representatives_come_through_fingerprints_and_trees(spark, docs_of, monkeypatch):
    """Without any band the BK-trees' components alone find copies a few bits apart; unlike texts of one component stay."""
    rng = random.Random(8)
    texts = []
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        texts += [" ".join(words), " ".join([*words[:-1], "other"])]
    sets = [simhash.shingle_set(t) for t in texts]
    bits = [((simhash.set_print(a) ^ simhash.set_print(b)) & (1 << 64) - 1).bit_count() for a, b in zip(sets[::2], sets[1::2])]
    near = {2 * i for i, n in enumerate(bits) if n <= simhash.RADIUS}
    assert len(near) > 20
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda prints, n: asked.append(n) or links(prints, n))
    made = simhash._with_components

    def alone(found):
        return made(found).withColumn("bands", F.slice("bands", 1, 1))

    monkeypatch.setattr(simhash, "_with_components", alone)
    got = {r["doc_id"] for r in simhash.representatives(docs_of(list(enumerate(texts)))).collect()}
    assert asked and got == set(range(60)) - {i + 1 for i in near}


# SQL and the pipeline


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    tidy = lambda df: df[cols].sort_values(cols).reset_index(drop=True)
    assert tidy(got).equals(tidy(want))


def test_pipeline_stages(spark, coder):
    import corpus_pipeline

    docs = table(spark, "documents")
    labels = {r["doc_id"]: r for r in table(spark, "labels").collect()}
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        out = simhash.materialise(stage(spark, docs, SF), name)
        at[name] = (docs, out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    ids = lambda df: [r["doc_id"] for r in df.collect()]
    kept = set(ids(at["quality"][1]))
    clean = [i for i, r in labels.items() if r["quality"] == 1]
    assert sum(i in kept for i in clean) > 0.98 * len(clean)
    before, after = (ids(x) for x in at["near_dedup"])
    scored = toxicity.score(at["toxicity"][0], table(spark, "labels")).where("score < 0.7")
    assert sorted(ids(at["toxicity"][1])) == sorted(ids(scored)) and len(ids(scored)) < len(kept)
    sets = {r["doc_id"]: shingles_of(r["text"]) for r in at["near_dedup"][0].collect()}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if v == old else v for k, v in root.items()}
    assert sorted(after) == sorted(set(root.values())) and len(after) < len(before)
    mixed = {}
    for i in ids(at["mix"][1]):
        mixed[i] = mixed.get(i, 0) + 1
    assert max(mixed.values()) <= 2
    texts = {r["doc_id"]: r["text"] for r in at["encode"][0].collect()}
    got = at["encode"][1].collect()
    assert len(got) == sum(mixed.values())
    assert all(r["n_tokens"] == len(coder.encode_ordinary(texts[r["doc_id"]])) for r in got)


def test_pipeline_of_nothing_and_oddities(spark, docs_of, tmp_path):
    import corpus_pipeline

    docs_of(EDGES).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (5, 1, 1)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[0] == "doc_id"
    empty = tmp_path / "empty"
    docs_of(EDGES, extra=False).limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
