import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm.mixing import Mix, mix_sources
from quire.llm.shared import new_folder
from quire.llm.token_store import Encoder, Reader, default_vocabulary, read_dictionary, read_tokens, write_tokens


def water(sizes, weights, share=1.5):
    """Targets by sharing out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free} | {s: 2.0 * sizes[s] for s in capped}
        above = {s for s in free if target[s] > 2 * sizes[s]}
        if not above:
            return target
        capped |= above


def test_targets_and_sizes(docs, texts):
    rows = mix_sources(docs).collect()
    sources = {7 * k + 3: None if k % 9 == 0 else f"s{k % 4}" for k in range(len(texts))}
    size = {7 * k + 3: len((t or "").encode().split()) for k, t in enumerate(texts)}
    of = {}
    for i, s in sources.items():
        of[s] = of.get(s, 0) + size[i]
    target = water(of, (3, 1, 2))
    taken, largest = dict.fromkeys(of, 0), dict.fromkeys(of, 0)
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == of[s] and r["target"] == pytest.approx(target[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in of:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    assert sorted(map(tuple, mix_sources(docs.repartition(2)).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_slices_find_the_same_cut(docs, monkeypatch):
    from quire.llm import mixing

    whole = sorted(map(tuple, mix_sources(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "ORDERED_AT_ONCE", 2)
    monkeypatch.setattr(mixing, "SLICES", 4)
    assert sorted(map(tuple, mix_sources(docs).collect()), key=str) == whole


def test_weights_and_odd_rows(spark, odd, nothing):
    rows = [(k, "w " * (k % 7 + 1), "a", float(k % 2)) for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, w double")
    found = mix_sources(frame, Mix(share=0.5), weight="w").collect()
    assert all(r["copies"] == 0 for r in found if r["doc_id"] % 2 == 0)
    assert abs(sum(r["taken"] for r in found) - found[0]["target"]) <= 4
    assert mix_sources(nothing).count() == 0
    odd_rows = mix_sources(odd).collect()
    assert len(odd_rows) == 6 and all(r["taken"] <= 2 * r["size"] for r in odd_rows)


def test_pieces_give_the_ids_of_whole_texts():
    encode, whole = Encoder(default_vocabulary()), Tokenizer.from_file(default_vocabulary())
    rng = random.Random(4)
    alphabet = [*" \n\t  abé1'.,s—你", "\x1c", "'s", "<|endoftext|>", "it's ", " the", "  ", "\r\n"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(3_000)]
    for k in range(0, len(texts), 50):
        for text, ids in zip(texts[k : k + 50], encode(texts[k : k + 50]), strict=True):
            assert np.frombuffer(ids, encode.kind).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_few_pieces_remembered(monkeypatch):
    from quire.llm import token_store

    monkeypatch.setattr(token_store, "PIECES_HELD", 3)
    encode, whole = Encoder(default_vocabulary()), Tokenizer.from_file(default_vocabulary())
    for text in ("to be, or\nnot to be.", "that is not", "to be", "x y z", "to be that"):
        assert np.frombuffer(encode([text])[0], encode.kind).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_round_trip_of_files(spark, docs, texts, monkeypatch):
    from quire.llm import token_store

    monkeypatch.setattr(token_store, "FILE_BYTES", 4_000)
    monkeypatch.setattr(token_store, "BUCKET_TEXT_BYTES", 50_000)
    folder = new_folder(spark, "tokens-test")
    files = write_tokens(docs, folder, default_vocabulary()).collect()
    assert len(files) > 6 and sum(f["documents"] for f in files) == len(texts)
    whole, start = Tokenizer.from_file(default_vocabulary()), 0
    found = {r["doc_id"]: r for r in read_tokens(spark, folder).collect()}
    for k, text in enumerate(texts):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        row = found[7 * k + 3]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    # One document alone, through the index.
    dictionary = read_dictionary(spark, folder)
    for f in files:
        content = open(f["path"].removeprefix("file://"), "rb").read()
        reader = Reader(content, dictionary)
        some = reader.doc_id(len(reader) - 1)
        assert reader.find(some)[0].tolist() == reader.ids(len(reader) - 1).tolist() and reader.find(-5) == []
        with pytest.raises(ValueError):
            Reader(content, dictionary + b"x")


def test_tokens_odd_rows(spark, odd, nothing):
    folder = new_folder(spark, "tokens-test")
    write_tokens(odd, folder, default_vocabulary())
    rows = sorted(map(tuple, read_tokens(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == [None, None, 1, 2, 2, 2] and rows[0][2] == 1
    assert all(a[1] + a[2] == b[1] for a, b in zip(rows, rows[1:], strict=False))
    folder = new_folder(spark, "tokens-test")
    write_tokens(nothing, folder, default_vocabulary())
    assert read_tokens(spark, folder).count() == 0


def test_pipeline_stages_against_their_operators(spark):
    from quire.llm.fourier_quality import score_quality

    from test_joins import brute_components, shingles

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "near_copies", "leaks", "mixture", "tokens"]
    (_, quality), (_, copies), (_, leaks), (_, mixture), (_, tokens) = corpus_pipeline.STAGES
    good = quality(spark, docs, d)
    scored = {r["doc_id"] for r in score_quality(docs, spark.read.parquet(f"{d}/labels.parquet")).filter("predicted = 1").collect()}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == scored
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    single = copies(spark, good, d)
    assert {r["doc_id"] for r in single.collect()} == {c for _, c in brute_components(rows).values()}
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    clean = leaks(spark, single, d)
    texts = {r["doc_id"]: shingles(r["text"]) for r in single.collect()}
    free = {i for i, s in texts.items() if not any(100 * len(x & s) >= 75 * len(x) for x in items)}
    assert {r["doc_id"] for r in clean.collect()} == free and clean.columns == docs.columns
    mixed = mixture(spark, clean, d)
    copies_of = {r["doc_id"]: r["copies"] for r in mix_sources(clean).collect() if r["copies"]}
    drawn = [r["doc_id"] for r in mixed.collect()]
    assert mixed.columns == docs.columns and {i: drawn.count(i) for i in drawn} == copies_of
    assert tokens(spark, mixed, d).count() == len(drawn)


def test_pipeline_stages_on_odd_rows(spark, odd, nothing):
    d = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, d).count() == 0
        found = stage(spark, odd, d)
        assert found.count() <= 12
    assert corpus_pipeline.near_copies(spark, odd, d).filter("doc_id = 2").count() == 1


def test_plain_pieces_are_encoded_by_the_model_with_the_ids_of_whole_texts():
    from quire.llm import token_store

    encoder = token_store.Encoder(token_store.default_vocabulary())
    whole, given = encoder.tokenizer, []

    class Counting:
        def encode(self, text, **options):
            return whole.encode(text, **options)

        def encode_batch(self, pieces, **options):
            given.extend(pieces)
            return whole.encode_batch(pieces, **options)

    encoder.tokenizer = Counting()
    texts = ["Déjà vu,\nein Straße. œuvre", "a1b2 x=3;y #tag $$$ (z)\nnext line", "don't 'tis you're", "mixed Жук 中文 x² ª ſſ ½", "", " ", "tab\tx \n y"]
    rng = random.Random(3)
    signs = "abZéÀÿœſ×÷ª012.,;!'$\"#~`^_|{}[]\\@&* \n\t ²µßЖ中-—"
    texts += ["".join(rng.choice(signs) if rng.random() < 0.4 else rng.choice("abcé the") for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    expected = [np.array(whole.encode(t, add_special_tokens=False).ids, encoder.kind).tobytes() for t in texts]
    assert encoder(texts) == expected
    given.clear()
    assert encoder(texts[:2]) == expected[:2]
    fresh = ["Quorvel blästen,\nzimt. œrt", "p7q8 v=9;w #mark %%% (t)\nlines"]
    assert encoder(fresh) == [np.array(whole.encode(t, add_special_tokens=False).ids, encoder.kind).tobytes() for t in fresh]
    assert set(given) <= {".", ",", "\n"}  # before: every piece was encoded as a text of its own


def test_remembered_pieces_of_two_workers_take_little_memory():
    from quire.llm import token_store

    # Two generations, two workers of an executor, some 220 bytes a piece: 132 MB (before: 352 MB).
    assert 2 * 2 * token_store.PIECES_HELD * 220 <= 150_000_000


def test_few_texts_at_once_and_memory_given_back(monkeypatch):
    import pyarrow as pa

    from quire.llm import token_store

    given = []
    monkeypatch.setattr(token_store, "release", lambda: given.append(1), raising=False)
    texts = [f"text {k}" for k in range(2_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2_000)), pa.array(texts)], ["doc_id", "text"])
    found = list(token_store._slices(batch, 1))
    assert [t for _, part in found for t in part] == texts
    assert max(len(part) for _, part in found) <= 300 and len(given) == len(found)
