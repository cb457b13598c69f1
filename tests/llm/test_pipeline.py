import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from conftest_llm import table
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from fleetfault.llm import decontam, hpylm, language, quality, token_counts, wavelet  # noqa: E402
from fleetfault.llm.words import span_hashes, text_bytes, word_spans  # noqa: E402

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")


LIBRARY = tokenizers.Tokenizer.from_file(WORD_FILE)


def coded(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [wavelet.END_ID]


# Token shards


def test_shard_answers(messy_rows):
    ids = np.array(sum((coded(r[1]) for r in messy_rows), []), np.uint32)
    shard = wavelet.Shard(wavelet.write_file(ids, np.arange(1), np.zeros(1), np.array([len(ids)])))
    assert (shard.ids() == ids).all()
    rng = random.Random(1)
    for _ in range(60):
        i = rng.randrange(len(ids))
        a, b = sorted(rng.sample(range(len(ids) + 1), 2))
        places = np.flatnonzero(ids == ids[i])
        k = rng.randrange(len(places))
        assert shard[i] == ids[i]
        assert shard.count(int(ids[i]), a, b) == ((places >= a) & (places < b)).sum()
        assert shard.find(int(ids[i]), k) == places[k]
    assert shard.count(60_000) == 0
    with pytest.raises(IndexError):
        shard.find(int(ids[0]), len(ids))


def test_shards_of_messy_table(messy, messy_rows, nothing):
    files = wavelet.write_shards(messy, WORD_FILE, shard_ids=3000)
    assert files.count() > 3
    got = sorted(wavelet.text_digests(files).collect(), key=lambda r: r.start)
    rows = sorted(messy_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    for row, found in zip(rows, got, strict=True):
        ids = coded(row[1])
        assert (found.doc_id, found.start, found.n_tokens) == (row[0], start, len(ids))
        assert found.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert wavelet.text_digests(wavelet.write_shards(nothing, WORD_FILE)).count() == 0


def test_resting_task_gives_memory_back(monkeypatch):
    import time

    from fleetfault.llm import words as module

    calls = []
    monkeypatch.setattr(module, "_give_back", lambda: calls.append(1))
    assert list(module.resting(iter([1, 2]), wait=0.2)) == [1, 2]
    assert list(module.resting(iter([3]), wait=0.2)) == [3]  # the next task comes first: one rest, not two
    time.sleep(0.6)
    assert calls == [1]
    with pytest.raises(ZeroDivisionError):
        list(module.resting((1 // k for k in (1, 0)), wait=0.05))
    time.sleep(0.4)
    assert calls == [1, 1]
    monkeypatch.undo()
    module._give_back()


def test_tasks_before_the_shards_rest(spark, messy, words, monkeypatch):
    """What the n-gram join and the decontamination leave in their workers is given back, too."""
    from fleetfault.llm import components, jaccard, sketch

    rested = {}
    for module in (jaccard, sketch, components, decontam):
        rested[module] = seen = spark.sparkContext.accumulator(0)

        def noted(batches, seen=seen):
            seen.add(1)
            yield from batches

        monkeypatch.setattr(module, "resting", noted)
    jaccard.one_of_each(messy).count()
    items = spark.createDataFrame([(1, " ".join(words[:30]))], "item_id long, text string")
    decontam.clean(messy, items).count()
    assert all(seen.value for seen in rested.values())


def test_encoder_equals_library():
    rng = random.Random(2)
    parts = ["a", "b.", " ", "A.", "'s", ",x", "\n", "é", "漢", "<|endoftext|>", "<|ENDOFTEXT|>", "e", "́", "th", "\t", "😀", "|",
             "1.5", "İ", "ΣΑΣ", "'S", "\x00", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    ids, sizes = wavelet.SpanEncoder(WORD_FILE).encode(*text_bytes(pa.array(texts)), 2)
    for text, end, size in zip(texts, np.cumsum(sizes), sizes):
        assert ids[end - size : end].tolist() == coded(text)


def test_marks_beside_letters():
    texts = ["casa### fin*** été!! É# ÿ. a=\u0338b é<\u0338 don't can't! x'S# 'll; ªº! ß_ ŉ? İ! ×! ÷, é\u0301! 5a%b", "",
             "<|endoftext|># a|b# |x|, K! ſ's, é\u00a0! a<|startoftext|>b <|endoftext|"]
    encoder = wavelet.SpanEncoder(WORD_FILE)
    for part in (texts, [x.upper() for x in texts], texts[::-1]):
        ids, sizes = encoder.encode(*text_bytes(pa.array(part)), 2)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [coded(x) for x in part]


def test_letters_are_fed_to_the_model_alone():
    encoder = wavelet.SpanEncoder(WORD_FILE)
    list(encoder.encode(*text_bytes(pa.array(["### !!"])), 2))
    encoder.tokenizer = None  # its normal forms and patterns cost more than its merges
    texts = ["casa###", "Straße Über a señor!!", "b"]
    assert encoder.encode(*text_bytes(pa.array(texts)), 2)[0].tolist() == sum(map(coded, texts), [])


def test_letters_that_the_model_lacks_are_fed_as_before():
    encoder = wavelet.SpanEncoder(WORD_FILE)
    encoder.ends[LIBRARY.encode("zebra").ids[-1]] = False
    texts = ["casa zebra", "zebra fin"]
    assert encoder.encode(*text_bytes(pa.array(texts)), 2)[0].tolist() == sum(map(coded, texts), [])


def test_known_spans_take_little_memory():
    import tracemalloc

    rng = random.Random(3)
    texts = pa.array([" ".join("".join(rng.choices("aeimnorst", k=9)) for _ in range(500)) for _ in range(100)])
    encoder = wavelet.SpanEncoder(WORD_FILE)
    tracemalloc.start()
    for k in range(100):
        encoder.encode(*text_bytes(texts[k : k + 1]), 2)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 110 * 50_000


# Token counts


def test_token_counts(messy, messy_rows, nothing):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(messy, PIECE_FILE).collect())
    n = [len(x) for x in library.encode([r[1] or "" for r in messy_rows], num_threads=1)]
    assert got == Counter((r[0], len((r[1] or "").encode()), k, k > 4096) for r, k in zip(messy_rows, n))
    assert token_counts.token_counts(nothing, PIECE_FILE).count() == 0


def test_transducer_equals_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "▁", "\n", "é", "漢", "<s>", "th", "ing", "\t", "😀", "ation", "'", "1", "Ti", " the", "\r\n", "ﷺ", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(4000)]
    got = token_counts.count_batch(token_counts.Transducer(PIECE_FILE), {}, pa.array(texts))
    assert got.tolist() == [len(x) for x in library.encode(texts, num_threads=1)]


# Quality


def test_quality_measures(messy, messy_rows, nothing):
    word = r"[^\x20\x09-\x0D]+"
    want = Counter()
    for key, text, *_ in messy_rows:
        text = text or ""
        words = re.findall(word, text)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        filled = [x for x in text.split("\n") if re.search(word, x)]
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        want[key, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(filled) - len(set(filled)), len(again), failed] += 1
    got = quality.quality(messy).collect()
    assert Counter((r.doc_id, *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.quality(nothing).count() == 0 and quality.clean(nothing).count() == 0


def test_line_rules(spark, words):
    prose = "\n".join(" ".join(words[k : k + 20]) + "." for k in range(0, 80, 20))
    menu = "\n".join(["Home", "one | two | three | four", "Click here", "All rights reserved.", "Short"])
    rows = [(1, prose, None, None, 9), (2, f"{prose}\n{menu}", None, None, 9), (3, f"{prose[:300]}\n" + "a | b | c | d | e | f | g h\n" * 30, None, None, 9)]
    got = {r.doc_id: (r.text, r.n_chars) for r in quality.clean(table(spark, rows)).collect()}
    assert got == {1: (prose, len(prose)), 2: (prose, len(prose))}


def brute_lost(text):
    """Words in lines that fail, found word by word."""
    lost = 0
    for line in (text or "").split("\n"):
        words = [x for x in re.split("[\x20\x09-\x0D]+", line) if x]
        loose = sum(c in "|»›•·>" for c in line) - sum(c in "«‹<" for c in line)
        ended = line.rstrip(" \t\n\v\f\r").rstrip("\"'”’»)]")[-1:]
        bad = len(words) < 3 and ended not in list(".!?…:;。！？")
        bad |= loose >= 3 and len(words) <= 5 * loose
        bad |= re.search(quality.MENU_LINE, line) is not None
        phrases = len(regex.findall(quality.BOILERPLATE, line))
        lost += len(words) if words and (bad or 0 < len(words) <= 12 * phrases) else 0
    return lost


def test_quality_verdicts(spark, messy, messy_rows, words):
    rng = random.Random(8)
    ends = [" | ", " » ", " «", "» ", " <b>", " • ", " privacy policy ", " ", " ", " ", " ", ".\n", "\n", "!»\n", ".)\n", "All rights reserved.\n"]
    rows = [(k, "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(40, 200))), "en", "a", 1) for k in range(100, 260)]
    for frame, given in ((messy, messy_rows), (table(spark, rows), rows)):
        got = Counter((r.doc_id, r.n_lost_words, r.base_failed, r.kept) for r in quality.quality(frame).collect())
        want = Counter()
        for (key, failed), times in Counter((r.doc_id, r.base_failed) for r in quality.quality(frame).collect()).items():
            for text in [x[1] for x in given if x[0] == key][:times]:
                n, lost = len(re.findall(quality.WORD, text or "")), brute_lost(text)
                want[key, lost, failed, not failed and 100 * lost <= 40 * n] += 1
        assert got == want
    assert {k[3] for k in got} == {True, False}


def test_clean_paragraphs_stay(spark):
    """One paragraph that quotes in guillemets, lists or names a policy is no menu and no page furniture."""
    said = "Le maire a dit « nous verrons » aux voisins, puis « rien ne presse » à la presse, et enfin « bonne nuit » à tous ceux qui restaient encore là."
    told = "Readers who care should look at the privacy policy of each service they use, since these texts say which data leave the device and who may read them later on."
    listed = "• a first point that runs over quite a few words, • a second point of about the same length, • and a third point that ends the list."
    other = " ".join(f"word{k}" for k in range(60)) + "."
    rows = [(k, f"{text} {other}", "fr", "a", 1) for k, text in enumerate((said, told, listed))]
    assert all(r.kept and r.n_lost_words == 0 for r in quality.quality(table(spark, rows)).collect())
    footer = "Accueil » Produits » Télé » Radio\nUse of cookies: privacy policy. All rights reserved."
    (row,) = quality.quality(table(spark, [(1, f"{said} {other}\n{footer}", "fr", "a", 1)])).collect()
    assert row.kept and row.n_lost_words == 15


# Benchmark


def brute_tiles(text, item, least):
    a, b, out = [False] * len(text), [False] * len(item), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(text)):
            for j in range(len(item)):
                k = 0
                while i + k < len(text) and j + k < len(item) and text[i + k] == item[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return out
        n, i, j = best
        out.append((i, j, n))
        a[i : i + n] = b[j : j + n] = [True] * n


def test_tiles_equal_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        letters = rng.choice([2, 3, 6])
        text, item = ([rng.randrange(letters) for _ in range(rng.randrange(1, n))] for n in (30, 14))
        least = min(3, len(item))
        assert decontam.tiles(np.array(text, np.uint64), np.array(item, np.uint64), least) == brute_tiles(text, item, least)


def test_contaminated(spark, messy, words, nothing):
    bench = spark.createDataFrame(
        [(1, " ".join(words[:40])), (2, " ".join(words[50:53])), (3, None), (4, ""), (4, " ".join(words[100:130])), (None, " ".join(words[200:230]))],
        "item_id long, text string",
    )
    moved = words[20:40] + ["between"] + words[:20]
    rows = [(k, " ".join(["start", *x, "end"]), None, None, 1) for k, x in enumerate(
        [words[:40], moved, words[:15], words[50:53], words[50:52], words[100:130], words[200:230], [w.upper() for w in words[:40]]])]
    rows += [(None, rows[0][1], None, None, 1), rows[0], (90, None, None, None, 1)]
    docs = table(spark, rows)
    fold = lambda w: "".join(c.lower() if c.isascii() else c for c in w)
    got = {(r.doc_id, r.item_id): r.n_covered for r in decontam.contaminated(docs, bench).collect()}
    want = {(0, 1): 40, (1, 1): 40, (None, 1): 40, (3, 2): 3, (5, 4): 30, (6, None): 30}
    if [fold(w.upper()) for w in words[:40]] == words[:40]:
        want[7, 1] = 40
    else:
        got.pop((7, 1), None)
    assert got == want
    kept = Counter(r.doc_id for r in decontam.clean(docs, bench).collect())
    assert {k for k in kept} >= {2, 4, 90} and not {0, 1, 3, 5, 6, None} & set(kept)
    assert decontam.clean(messy, bench).count() == messy.count() and decontam.clean(nothing, bench).count() == 0
    assert decontam.clean(docs, bench.limit(0)).count() == len(rows)


# Models


def test_language_on_held_out_rows(spark):
    rng = random.Random(4)
    alphabets = {"en": ["the", "and", "thing", "water"], "de": ["der", "und", "schon", "wasser"], "fr": ["le", "et", "chose", "eau"]}
    say = lambda lang, n: " ".join(rng.choice(alphabets[lang]) + rng.choice(alphabets[lang]) for _ in range(n)) + ", 12 ."
    rows = [(k, say(lang, 20), lang, "a", 1) for k in range(120) for lang in [rng.choice(list(alphabets))]]
    rows += [(900, None, "en", "a", 1), (901, " 12 -- ", "en", "a", 1), (902, "", None, "a", 1), (None, say("de", 20), None, "a", 1)]
    docs = table(spark, rows)
    field = language.fit(docs.where(~language.held_out(docs["doc_id"])))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, field).collect()}
    held = [r for r in rows if r[0] is not None and r[0] < 900 and zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[r[0]][0] == r[2] for r in held) >= 0.95 * len(held)
    assert [got[k][0] for k in (900, 901, 902, None)] == ["und", "und", "und", "de"]
    assert all(0 <= s <= 1 for _, s in got.values())
    mixed = pa.array([say("en", 30) + " " + say("de", 60)])
    best, score = field.predict(mixed)
    assert field.labels[best[0]] == "de" and 0.5 < score[0] < 0.8
    assert language.identify(docs, language.fit(docs.limit(0))).where("lang_pred != 'und'").count() == 0


def test_rare_languages_are_learnt(spark):
    """A language in one of 700 rows, and one found in long texts only."""
    rng = random.Random(4)
    alphabets = {"en": ["the", "and", "thing"], "de": ["der", "und", "schon"], "fi": ["yksi", "kuusi", "talo"], "pl": ["jest", "czy", "dobrze"]}
    say = lambda lang, n: " ".join(rng.choice(alphabets[lang]) for _ in range(n))
    rows = [(k, say(lang, 12), lang) for k in range(2100) for lang in ["fi" if k % 700 == 5 else rng.choice(["en", "de"])]]
    rows += [(3000 + k, say("pl", 6000), "pl") for k in range(3)]
    field = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert field.labels == ["de", "en", "fi", "pl"]
    best, _ = field.predict(pa.array([say(lang, 12) for lang in field.labels]))
    assert best.tolist() == [0, 1, 2, 3]


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    move = rng.normal(size=(3, 3))
    lengths = np.array([2, 5, 1, 0, 4])
    scores = rng.normal(size=(lengths.sum(), 3))
    got = language.forward_backward(scores, lengths, move)
    begin = 0
    for n in lengths:
        want = np.zeros((n, 3))
        for path in product(range(3), repeat=int(n)):
            weight = np.exp(sum(scores[begin + t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            for t, y in enumerate(path):
                want[t, y] += weight
        if n:
            assert np.allclose(got[begin : begin + n], want / want.sum(1, keepdims=True))
        begin += n


def test_language_model(messy, messy_rows, nothing):
    import math
    held = lambda key: zlib.crc32(("" if key is None else str(key)).encode()) % 5 == 1
    fold = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    tokens = [(r[0], [*re.findall(r"[^\x20\x09-\x0D]+", fold(r[1] or "")), None]) for r in messy_rows]
    counts = Counter(w for key, ws in tokens if not held(key) for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    want = Counter()
    for key, ws in tokens:
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)
        want[key, held(key), len(ws), sum(w in counts for w in ws), total, round(base, 4)] += 1
    got = hpylm.score(messy).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got) and sum(r.score - r.base_score for r in got) > 0
    assert hpylm.score(nothing).count() == 0


def test_every_word_is_a_context(spark, monkeypatch):
    """Words below one in 32,768 of the training words still teach what follows them."""
    monkeypatch.setattr(hpylm, "BUCKET_TOKENS", 10_000)  # 33 buckets
    rng = random.Random(5)
    filler = [f"w{k}" for k in range(300)]
    prose = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    pairs = [f"{prose(1)} a{k} {b} {prose(1)}" for k in range(60) for b in (f"b{k}", "w7") for _ in range(4)]
    rng.shuffle(pairs)
    texts = [prose(1000) + " " + " ".join(pairs[k::330]) for k in range(330)]
    asked = [f"a{k} {b}" for k in range(60) for b in (f"b{k}", f"b{(k + 1) % 60}", "w7", "w8")]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, t) for k, t in enumerate(asked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in hpylm.score(docs, F.col("doc_id") >= 1000).collect()}
    assert got[0].train_tokens > 8 * 32_768
    scores = np.array([got[1000 + k].score for k in range(len(asked))]).reshape(60, 4)
    # Half of what followed is the rare word, half the frequent one; the others never did.
    assert (scores[:, 0] - scores[:, 1] > 1).all() and (scores[:, 2] - scores[:, 3] > 1).all()


def test_seating_follows_the_restaurant():
    """Tables of 12 customers under a fixed concentration, beside direct simulation."""
    rng = np.random.default_rng(5)
    got = hpylm.seat(rng, np.full(20_000, 12), np.full(20_000, 2.0), 0.5).mean()
    sums = 0
    for _ in range(4000):
        tables = 1
        for n in range(1, 12):
            tables += rng.random() < 2.0 / (2.0 + n - 0.5 * tables)
        sums += tables
    assert abs(got - sums / 4000) < 0.1
    assert hpylm.seat(rng, np.array([0, 1, 1000]), np.ones(3), 0.5)[:2].tolist() == [0, 1]


# Words and pipeline


def test_word_hashes_tell_words_apart(messy_rows):
    data, borders = text_bytes(pa.array([r[1] for r in messy_rows]))
    rows, starts, ends = word_spans(data, borders)
    want = [(k, w.encode()) for k, r in enumerate(messy_rows) for w in re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")]
    assert [(k, data[a:b].tobytes()) for k, a, b in zip(rows.tolist(), starts, ends)] == want
    names = span_hashes(data, starts, ends)
    assert len({(h, w) for h, (_, w) in zip(names.tolist(), want)}) == len({w for _, w in want}) == len(set(names.tolist()))


def test_pipeline_stages(spark, messy, messy_rows, nothing, tmp_path, words):
    for rows, frame in (("full", messy), ("empty", nothing)):
        folder = tmp_path / rows
        frame.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, " ".join(words[:30]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(folder))
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == frame.columns
            out.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k == 3:
                expected = Counter(r.doc_id for r in docs.select("doc_id").collect())
        assert Counter(r.doc_id for r in docs.select("doc_id").collect()) == expected
        assert (docs.count() > 5) == (rows == "full")
