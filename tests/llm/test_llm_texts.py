"""Toxicity, languages, tokens, packing, sharding, chats and media: brute force, round trips, held-out accuracy."""

import hashlib
import itertools
import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from kindred.llm import chat, langid, media, packing, sentencepiece, sharding, toxicity
from kindred.llm.words import word_tokenizer

ODD = ["", " ", "a", "é", "É́", "H̱", "don't stop...", "x<|endoftext|>y", "İ!", "Σς", "漢字かな", "💥 \x00\t\n", "A  b", " lead", "trail ", "▁▁", "…»!", "1 9 ９"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, score string, offset int")


# words and pieces


def test_word_ids_equal_the_tokenizers():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    plain, words = Tokenizer.from_file(path), word_tokenizer(path)
    rng = np.random.default_rng(0)
    texts = [*ODD, *("".join(rng.choice([*ODD, " ", ".", "'s"], 6)) for _ in range(2000))]
    for text, ids in zip(texts, words.batch(texts), strict=True):
        assert plain.encode(text, add_special_tokens=False).ids == ids.tolist(), text


def best_segmentation(automaton, pieces, text):
    scores = {t: (s, i) for t, s, i in pieces}
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - 16), end):
            if (part := text[begin:end]) in scores:
                best[end] = max(best[end], best[begin] + scores[part][0])
            elif end - begin == 1:
                best[end] = max(best[end], best[begin] + automaton.spelled)
    return best[-1]


def test_segmentations_are_the_best():
    path = sentencepiece.model_path()
    pieces, byte_ids, spelled = sentencepiece.pieces_of(path)
    automaton, score = sentencepiece.Automaton(pieces, byte_ids), {i: s for _, s, i in pieces}
    for text in ["the quick brown fox", "  double", "unknown 漢字 𝛼 ﬁ", "ththtionre erlyth", "\n\n\t"]:
        ids = automaton.encode(text)
        spelled_chars = sum(1 for c in text if not any(c == t for t, _, _ in pieces))
        total = sum(score[i] for i in ids if i in score) + automaton.spelled * spelled_chars
        assert total == pytest.approx(best_segmentation(automaton, pieces, text))
        assert b"".join(spelled[i] for i in ids).decode() == text


def test_pieces_round_trip(spark):
    rows = [*enumerate(ODD), (50, None), (None, "x"), (1, "a"), (51, "word " * 3000)]
    model = sentencepiece.model_path()
    found = sentencepiece.decode_ids(sentencepiece.encode_texts(docs(spark, rows), model), model).collect()
    assert Counter(r["text"] for r in found) == Counter(t or "" for _, t in rows)
    assert sentencepiece.encode_texts(docs(spark, []), model).count() == 0


# packing


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_packing(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    found = packing.packed_pieces(table, packing.tokenizer_path(), per_partition=20).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in table.collect()}
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: r["piece"]):
        assert r["start"] == len(got[r["doc_id"]])
        own = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert len(own) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        got[r["doc_id"]] += own
    assert got == ids
    least = -(-sum(map(len, ids.values())) // packing.CAPACITY)
    assert check_packing(found, packing.CAPACITY) <= least * 1.05 + 1


def test_packing_odd_rows(spark):
    rows = [(1, None), (1, None), (None, "a"), (2, "b " * 9000)]
    found = packing.packed_pieces(docs(spark, rows), packing.tokenizer_path()).collect()
    assert Counter(r["doc_id"] for r in found) == Counter({1: 2, None: 1, 2: 3})
    check_packing(found, packing.CAPACITY)
    assert packing.packed_pieces(docs(spark, []), packing.tokenizer_path()).count() == 0


def test_best_fit():
    bins, offsets = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 8]


def test_bins_that_nothing_fits_are_done():
    assert packing.most_held({2100: 4000}, 4096) < 2100
    assert packing.most_held({2100: 4000, 3000: 10}, 4096) < 2100
    assert packing.most_held({2100: 5, 2500: 7, 3000: 10, 100: 6}, 4096) == 2999
    assert packing.most_held({1000: 50, 2000: 3}, 4096) == 3096
    assert packing.most_held({}, 4096) == 0


def test_items_over_half_do_not_climb(spark):
    """4,000 items of 2,100 tokens and few small ones, which all find room in them."""
    items = spark.range(4000).select(F.col("id").alias("item"), F.when(F.col("id") < 3960, 2100).otherwise(300).cast("long").alias("length"))
    found = packing.pack(items, per_partition=50).collect()
    rows = [{"sequence_id": r["sequence_id"], "offset": r["offset"], "length": 2100 if r["item"] < 3960 else 300} for r in found]
    assert len(rows) == 4000 and check_packing(rows, packing.CAPACITY) == 3960


# sharding


def test_matrix_margins_and_repeatability():
    counts, sizes = [7, 0, 13, 5, 1], np.array([9, 9, 8])
    rows = np.array([sharding.matrix_row(counts, sizes, p, 1) for p in range(5)])
    assert rows.sum(axis=0).tolist() == sizes.tolist() and rows.sum(axis=1).tolist() == counts
    assert (rows == np.array([sharding.matrix_row(counts, sizes, p, 1) for p in range(5)])).all()


def test_large_hypergeometric():
    rng = np.random.default_rng(0)
    drawn = [sharding.hypergeometric(rng, 2 * 10**9, 3 * 10**9, 10**6) for _ in range(200)]
    assert abs(np.mean(drawn) - 400_000) < 150 and 300 < np.std(drawn) < 700


@pytest.mark.parametrize(("n", "bucket"), [(0, 10), (3, 10), (1000, 10), (1000, 50_000)])
def test_shards(spark, n, bucket):
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("_part"), F.lit("x").alias("shard")).repartition(3)
    found = sharding.shuffled_shards(rows, 7, bucket_rows=bucket).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(n))
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1


def test_shuffle_is_uniform(spark):
    hits = Counter()
    for seed in range(60):
        found = sharding.shuffled_shards(spark.range(12).select(F.col("id").alias("doc_id")).coalesce(2), 3, seed=seed).collect()
        hits.update(r["shard"] for r in found if r["doc_id"] == 0)
    assert set(hits) == {0, 1, 2} and max(hits.values()) < 35


# chats


@pytest.mark.parametrize("text", ["", "<", "|", "<|", "|>", "<|end|>\n", "<<>", "<!>", "!>", "<!", "</s>[INST] ok", "a<|user|>b"])
def test_escapes(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "|" not in chat.escape(text)


def test_chats(spark, folder):
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    rows += [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role, text or ""))
    wanted = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        wanted[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    found = chat.op7_chat_formatting(spark, folder).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in found} == wanted


def test_examples_are_prefixes(spark):
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", None), (1, 3, "assistant", "b"), (1, 4, "user", "end"), (2, 0, None, "x")], "conv_id long, turn int, role string, text string")
    found = {(r["conv_id"], r["example"]): r for r in chat.prefix_examples(rows).collect()}
    assert [found[1, i]["trainable"] for i in range(3)] == [True, True, False]
    assert found[1, 1]["context"].startswith(found[1, 0]["context"] + found[1, 0]["target"])
    assert chat.parse(found[1, 2]["context"]) == [("user", "q"), ("assistant", "a"), ("user", ""), ("assistant", "b"), ("user", "end")]
    assert found[2, 0]["trainable"] is False
    assert chat.prefix_examples(rows.limit(0)).count() == 0


def test_chats_sql(spark, folder):
    compare(spark, folder, chat.op7_chat_formatting, chat.OP7_SQL)


def test_ids_stay_exact_beside_nulls(spark):
    big = (1 << 62) + 1
    rows = spark.createDataFrame([(big, 0, "assistant", "a"), (None, 0, "user", "b"), (None, 1, None, None)], "conv_id long, turn int, role string, text string").coalesce(1)
    found = chat.read_back(chat.prefix_examples(rows)).collect()
    assert sorted((r["conv_id"] or 0, r["n_turns"], r["loss_chars"]) for r in found) == [(0, 2, 0), (big, 1, 1)]


def test_a_long_conversation(spark, monkeypatch):
    rows = [(1, i, "assistant" if i % 2 else "user", f"<|{i}|>" * 40) for i in range(400)]
    found = chat.read_back(chat.prefix_examples(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()
    assert [(r["n_turns"], r["loss_chars"]) for r in found] == [(400, sum(len(t) for _, i, _, t in rows if i % 2))]


# media


@pytest.mark.parametrize("n", [192, 2880, 2881 // 192 * 192, 5760, 192 * 131])
def test_streams_round_trip(n):
    payload = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
    data = media.write_stream(payload)
    found = media.read_stream(data)
    assert found.payload == payload and len(data) % 188 == 0
    assert (found.damaged, found.discontinuities) == (0, 0)
    assert found.stamps == [k * media.TICKS for k in range(-(-n // media.UNIT))]
    assert found.entries == list(range(0, len(found.stamps), media.GROUP))
    assert (found.programs, found.streams) == ({1: media.PMT_PID}, {media.ES_PID: media.PRIVATE_DATA})


def test_damage_is_noticed():
    data = bytearray(media.write_stream(bytes(range(192)) * 60))
    lost = media.read_stream(bytes(data[: 188 * 5] + data[188 * 6 :]))
    assert lost.discontinuities == 1 and lost.damaged == 1
    data[188 * 4] = 0
    assert media.read_stream(bytes(data)).damaged >= 1
    data[10] ^= 1
    assert media.read_stream(bytes(data)).programs in ({}, {1: media.PMT_PID})
    assert media.read_stream(b"").payload == b""


def test_known_checksum():
    assert media.crc_mpeg(b"123456789") == 0x0376E6E7


def test_media_columns(spark):
    rows = [(1, None), (2, ""), (3, "é" * 100), (3, "é" * 100), (None, "x" * 10_000)]
    found = media.media_columns(media.with_media(docs(spark, rows))).collect()
    for r, (_, t) in zip(sorted(found, key=lambda r: (r["doc_id"] or 9, r["n_bytes"])), rows, strict=True):
        raw = (t or "").encode()
        assert r["payload"] == raw.ljust(max(192, -(-len(raw) // 192) * 192)) and r["n_bytes"] == len(raw)
    assert media.with_media(docs(spark, [])).count() == 0


# languages


def phrases_by_hand(sample, text):
    count = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        count, at = count + 1, at + size
    return count


def test_phrases_equal_longest_matches():
    model = langid.Model({"aa": "abracadabra abba", "bb": "banana bandana"})
    decoded = {k: "".join(chr(65 + s) for s in model.encode(v)) for k, v in (("aa", "abracadabra abba"), ("bb", "banana bandana"))}
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcdnr z"), 40)) for _ in range(50)] + ["", "é", "zzz"]
    encoded = [model.encode(t) for t in texts]
    counts = langid.phrases(model, encoded)
    for e, row in zip(encoded, counts, strict=True):
        assert row.tolist() == [phrases_by_hand(decoded[k], "".join(chr(65 + s) for s in e)) for k in model.langs]


@pytest.mark.parametrize("block", [1, 2, 5, 16])
def test_phrases_run_across_blocks(block, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", block)
    test_phrases_equal_longest_matches()


def test_phrases_of_a_long_text():
    rng = np.random.default_rng(5)
    sample = "".join(rng.choice(list("abc "), 3000))
    model = langid.Model({"aa": sample, "bb": sample[:50] * 40})
    text = model.encode(sample[100:2600] + "".join(rng.choice(list("abcd "), 4000)) + sample[:50] * 60)
    decode = lambda e: "".join(chr(65 + s) for s in e)
    assert len(text) > 3 * langid.BLOCK
    assert langid.phrases(model, [text, text[:10]])[0].tolist() == [phrases_by_hand(decode(model.encode(s)), decode(text)) for s in (sample, sample[:50] * 40)]


def test_languages_of_other_scripts(spark):
    samples = {"zh": "我们今天去图书馆看书因为天气很好他们也想一起来学习中文和历史", "ja": "今日は天気がいいので図書館へ行って本を読みますとても楽しいです", "ko": "오늘은 날씨가 좋아서 도서관에 가서 책을 읽습니다 정말 재미있어요", "ru": "сегодня хорошая погода и мы пойдём в библиотеку читать книги", "en": "the weather is fine today and we go to the library to read books"}
    model = langid.Model(samples)
    rows = [(1, "我们去看书"), (2, "本を読みます"), (3, "책을 읽습니다"), (4, "мы читаем книги"), (5, "we read the books"), (6, "𓀀𓀁")]
    found = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs(spark, rows), model).collect()}
    assert [found[i] for i in range(1, 6)] == ["zh", "ja", "ko", "ru", "en"] and found[6] in samples


def test_few_languages_of_many_are_learned(spark):
    rows = spark.createDataFrame([(i, "abc def" if i % 3 else "xyz", f"l{i % 3}" if i % 3 else f"odd{i}") for i in range(60)], "doc_id long, text string, lang string")
    assert langid.fit(rows, sample_langs=2).langs == ["l1", "l2"]


def test_language_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    found = langid.op4_language_id(spark, folder).collect()
    held = [r for r in found if r["held_out"] and r["lang_pred"] != "und"]
    assert all(0 <= r["score"] <= 1 for r in found) and len(found) == len(langs)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) / len(held) > 0.97


def test_language_of_odd_rows(spark):
    rows = docs(spark, [(1, None), (2, ""), (3, "123 ..."), (4, "abc"), (None, "bbb")])
    found = langid.predict(rows, langid.Model({"aa": "abc abc", "bb": "bbb"})).collect()
    assert [(r["lang_pred"], r["offset"]) for r in found] == [("und", 1)] * 3 + [("aa", 1), ("bb", 1)]
    assert langid.predict(rows.limit(0), langid.Model({})).count() == 0
    assert {r["lang_pred"] for r in langid.predict(rows, langid.Model({})).collect()} == {"und"}


def test_language_with_a_short_sample(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)]
    model = langid.Model({"aa": "".join(rng.choice(list("abcdefgh "), 24_000)), "bb": " ".join(words[:20])})
    found = langid.predict(docs(spark, [(i, " ".join(rng.choice(words, 20))) for i in range(40)]), model).collect()
    assert sum(r["lang_pred"] == "bb" for r in found) >= 36


def test_languages_of_many_letters(spark):
    first, second = ("".join(chr(at + i) for i in range(400)) for at in (0x4E00, 0x5E00))
    model = langid.Model({"aa": first, "bb": second})
    assert langid.phrases(model, [model.encode(second[300:340])]).tolist() == [[40, 1]]
    found = langid.predict(docs(spark, [(1, second[300:340]), (2, first[300:340])]), model).collect()
    assert sorted((r["doc_id"], r["lang_pred"]) for r in found) == [(1, "bb"), (2, "aa")]


# toxicity


def test_kernel_counts_common_subsequences():
    model = toxicity.fit_texts([], ["abcdefgh"])
    code = lambda t: model.encode(t)[1 : toxicity.REACH + 1]
    a, b = code("abcdefghabcdef"), code("acdxefgabcdefg")

    def counts(row):
        out = Counter()
        for i, (p, q, w) in itertools.product(range(toxicity.PLACES), toxicity.STEPS):
            out[row[i], row[i + p], row[i + p + q]] += w
        return out

    x, y = counts(a.tolist()), counts(b.tolist())
    kernel = toxicity.Kernel(np.stack([b]))
    wanted = sum(v * y[k] for k, v in x.items()) / np.sqrt(sum(v * v for v in y.values()))
    assert kernel(np.stack([a]))[0, 0] == pytest.approx(wanted, rel=1e-5)
    table = kernel.expand(np.array([2.0]))
    assert toxicity.stretch_sums(a, table)[0] == pytest.approx(2 * wanted, rel=1e-4)


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = toxicity.op1_toxicity(spark, folder).collect()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    hits = Counter(held)
    assert hits[1, 1] / (hits[1, 1] + hits[0, 1]) > 0.85
    assert hits[1, 0] / (hits[1, 0] + hits[0, 0]) < 0.01
    assert all(0 <= r["score"] <= 1 for r in found)


def test_toxicity_without_labels(spark):
    rows = docs(spark, [(1, None), (2, ""), (3, "x" * 5000)])
    model = toxicity.fit(rows, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [round(r["score"], 6) for r in toxicity.score_texts(rows, model).collect()] == [0, 0, 0]
    assert toxicity.score_texts(rows.limit(0), model).count() == 0


def test_stream_feature_is_json(spark, folder):
    row = media.op8_media_columns(spark, folder).first()
    assert json.loads(row["feature"].split("programs=")[1].split(";")[0]) == {"1": media.PMT_PID}
