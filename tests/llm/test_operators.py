"""Each operator on a small hard table against a brute-force version."""

from __future__ import annotations

import base64
import collections
import hashlib
import io
import itertools
import math
import random
import re
import sys
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crossfactor.llm import bpe, exact_dedup, langid, minhash, packing, pii, quality, sharding, token_files, toxicity
from crossfactor.llm.tokens import encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __text string, `__shard x` int"


def prose(count, seed, syllables=("tion", "er", "an", "the", "re", "ing", "on", "st")):
    rng = random.Random(seed)
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(count)]
    return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, count, 9)) + "."


LONG = prose(30_000, 99)
BASE = prose(120, 1)
WORDS = BASE.split(" ")
TEXTS = {
    1: BASE,
    2: BASE,
    3: BASE.replace(" ", "\n", 3) + " ",
    4: " ".join([*WORDS[:60], "edited", *WORDS[61:]]),
    5: " ".join([*WORDS[:20], "other", *WORDS[21:]]),
    6: prose(150, 2),
    7: None,
    8: "",
    9: " \t\n",
    10: LONG,
    11: "word",
    12: "é ü ñ 日本 \U0001f600",
    13: "a b c d e f " * 40,
    14: prose(80, 3, ("ung", "der", "sch", "ein", "keit", "ü")),
    15: "12 34 ###",
    16: "  two  spaces\n\n and\ttabs ",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "de" if i == 14 else "en", f"s{i % 3}", None if t is None else len(t), "clash", 1) for i, t in TEXTS.items()]
    rows.append((1, TEXTS[1], "en", "s1", len(BASE), "clash", 1))  # a repeated row
    rows.append((None, "no name at all", None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


ROWS = [*TEXTS.items(), (1, BASE), (None, "no name at all")]


def test_exact_dedup(docs, empty, monkeypatch):
    groups = collections.defaultdict(list)
    for i, t in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), math.inf if i is None else i))
    wanted = sorted((i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g)
    for held in (1 << 20, 1):  # with a budget of one byte each insertion evicts
        monkeypatch.setattr(exact_dedup, "TRIE_BYTES", held)
        got = sorted((math.inf if r.doc_id is None else r.doc_id, math.inf if r.keep_id is None else r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.mark(docs).collect())
        assert got == wanted
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 9, 10, 11, 12, 13, 14, 15, 16, None}
    assert exact_dedup.mark(empty).count() == 0


def test_trie_against_a_dictionary():
    rng = random.Random(4)
    trie, wanted = exact_dedup.PatriciaTrie(), collections.defaultdict(list)
    for i in range(4000):
        key = bytes(rng.choices(b"ab\x00\xff", k=rng.randint(0, 9)))
        trie.insert(key, i % 7, i)
        wanted[key].append((-(i % 7), i))
    found = {}
    while trie.held:
        found |= {k: (b, n) for k, b, n in trie.pop(trie.largest())}
    found |= {k: (b, n) for k, b, n in trie.pop()}
    assert found == {k: ((-min(v)[0], min(v)[1]), len(v)) for k, v in wanted.items()} and trie.bytes == 0


def test_sharding(docs, empty):
    tree = sharding.balanced(16)
    rows = sharding.shard(docs, tree, sharding.grow(tree)).collect()
    assert len(rows) == len(ROWS)
    sizes = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS}
    assert all((r["size"], r.text_crc32) == sizes[r.doc_id] and r.grown_shard in (r["shard"], 16) and r.law == "key" for r in rows)
    for _, part in itertools.groupby(sorted(rows, key=lambda r: r["shard"]), key=lambda r: r["shard"]):
        assert sorted(r.slot for r in part) == list(range(len([r for r in rows if r["shard"] == _])))
    assert sharding.shard(empty, tree).count() == 0


def test_tree_follows_weights_and_confines_moves(spark):
    ids = spark.range(40_000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    tree = sharding.balanced(16)
    place = lambda t: {r.doc_id: r["shard"] for r in sharding.shard(ids, t).collect()}
    before, after = place(tree), place(sharding.grow(tree))
    share = collections.Counter(before.values())
    assert len(share) == 16 and all(abs(n - 2500) < 250 for n in share.values())
    moved = [after[i] for i in before if after[i] != before[i]]
    assert set(moved) == {16} and abs(len(moved) - 40_000 / 17) < 250
    twice = place(sharding.grow(sharding.grow(tree)))
    assert {twice[i] for i in after if twice[i] != after[i]} == {17}


def word_file():
    return public_tokenizers.path("word_bpe_49k.json")


def byte_file():
    return public_tokenizers.path("byte_bpe_50k.json")


HARD = [t or "" for _, t in ROWS if t != LONG] + ["CAN'T, it's. ÉÀ, Σας Å. é. İ, ﬁ, x̸,", "<|endoftext|> x<|endoftext|>", "hi <|endoftext|> there <|ENDOFTEXT|> <|startoftext|>", "a　b c\x1cd \x1c e", "x\n \ny", " lead", "tail "]


@pytest.mark.parametrize(("path", "style"), [(word_file(), "words"), (byte_file(), "bytes")])
def test_cached_ids_are_the_librarys(path, style):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    rng = random.Random(7)
    texts = HARD + ["".join(rng.choices("aAé' .,\n\t!9#ñ ́", k=rng.randint(1, 30))) for _ in range(3000)]
    for _ in range(2):
        got = encoder(path, style).encode([t.encode() for t in texts])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_byte_ids_at_every_kind_of_cut():
    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(byte_file()), random.Random(8)
    texts = [f"a{c}b {c}{c} {c}\n{c}\n\n{c}, x{c} \n{c}'s{c}" for c in map(chr, [*range(0x530), *range(0x2000, 0x2070), 0x1680, 0x180E, 0x3000, 0xFEFF, 0x1F600])]
    for letters in ["a \n.'s", "  \n\na×÷й1 \r\x85\u00a0\u2003\u3000.", "x\x1c\t \n,\x00\x7fβ中"]:
        texts += ["".join(rng.choices(letters, k=rng.randint(0, 25))) for _ in range(2000)]
    texts += ["w" * 100_000, " " * 70_000, "", " ".join(prose(9, i) for i in range(3000))]
    got = encoder(byte_file(), "bytes").encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_words_share_calls_of_the_library():
    rng, calls = random.Random(9), []
    texts = [" ".join("".join(rng.choices("abcdefghé", k=9)) for _ in range(100)).encode() for _ in range(50)]
    own = encoder(byte_file(), "bytes")
    sys.setprofile(lambda frame, event, arg: calls.append(arg.__name__) if event == "c_call" else None)
    try:
        own.encode(texts)
    finally:
        sys.setprofile(None)
    assert 0 < calls.count("tokenize") + calls.count("encode_batch_fast") < 10


def test_rows_are_encoded_in_runs_across_batches():
    rows = [(None, b"x" * 40), (1, b""), (1, b"y" * 400), (2, b"z" * 5000), (3, b"w")]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": [t]}) for i, t in rows]
    found = list(token_files.runs(iter(batches), 1000))
    assert [(i, t) for names, texts in found for i, t in zip(names, texts, strict=True)] == rows
    assert [len(names) for names, _ in found] == [3, 1, 1] and list(token_files.runs(iter([]), 1000)) == []


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(word_file())
    ids = {i: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in ROWS}
    for group in (20_000, 6):
        rows = packing.pack(docs, word_file(), group_pieces=group).collect()
        assert len(rows) == sum(-(-len(ids[i]) // 2048) for i, _ in ROWS)
        for r in rows:
            part = ids[r.doc_id][r.start : r.start + r.length]
            assert r.start == 2048 * r.piece and r.length == len(part) and r.ids_crc32 == zlib.crc32(part.tobytes())
        for _, part in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
            at = 0
            for r in part:
                assert r.offset == at
                at += r.length
            assert at <= 2048
    assert len({r.sequence_id for r in packing.pack(docs, word_file()).collect()}) == -(-sum(len(ids[i]) for i, _ in ROWS) // 2048)
    assert packing.pack(empty, word_file()).count() == 0


def test_local_search_empties_bins():
    rng = np.random.default_rng(3)
    for sizes in ([6, 5, 5, 4], rng.integers(1, 100, 300), rng.integers(34, 60, 90)):
        sizes = np.array(sizes)
        room = 10 if len(sizes) == 4 else 100
        start = [[i] for i in range(len(sizes))]
        bins = packing.local_search(start, sizes, room)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and max(sizes[b].sum() for b in bins) <= room
        assert len(packing.local_search(packing.best_fit(sizes, room), sizes, room)) <= len(packing.best_fit(sizes, room))
    assert len(packing.local_search([[0, 3], [1], [2]], np.array([6, 5, 5, 4]), 10)) == 2


def test_local_search_takes_all_underfull_bins():
    rng = np.random.default_rng(1)
    for sizes, room, most in ((rng.integers(600, 761, 2000), 2048, 700), (rng.integers(10, 31, 900), 64, 10**6), (rng.integers(1, 22, 1200) * 3, 64, 10**6)):
        start = packing.best_fit(sizes, room)
        bins = packing.local_search(start, sizes, room)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and max(sizes[b].sum() for b in bins) <= room
        assert len(bins) <= min(most, len(packing.drained(start, sizes, room)))
        if len(bins) > -(-sizes.sum() // room):
            parts = [sorted((int(sizes[i]), i) for i in b) for b in bins if sizes[b].sum() < room]
            for giver, taker in itertools.permutations(parts, 2):
                gap = room - sum(x for x, _ in taker)
                assert gap > room - sum(x for x, _ in giver) or not packing.exchange(giver, taker, gap)


def test_quality(docs, empty):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t in ROWS:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        twice = {w for w, n in collections.Counter(windows).items() if n > 1}
        covered = {k + j for k, w in enumerate(windows) if w in twice for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wanted = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == wanted
        assert r.base_failed == (len(words) < 50 or 2 * len(covered) > len(words))
    assert {i for i, r in got.items() if r.kept} == {1, 2, 3, 4, 5, 6, 10, 14} - ({10} if got[10].base_failed else set())
    assert quality.judge(empty).count() == 0 and quality.clean(docs).columns == docs.columns


def test_quality_lines(spark):
    good = prose(90, 5)
    texts = [f"{good}\nHome | News | About | Login\nclick here to go on.", f"{good[:200]}.\n" + "\n".join(f"item {i} no end" for i in range(60)), "\n".join([good.upper()] * 2), re.sub(r"(\w+)", r"\1###", good)]
    out = quality.clean(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert [(r.doc_id, r.text) for r in out] == [(0, good)]


def test_language(spark, docs, empty):
    rows = [(i, prose(40, i) if i % 2 else prose(40, i, ("ung", "der", "sch", "ein", "keit", "ü")), "en" if i % 2 else "de") for i in range(100, 160)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(docs.select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in langid.predict(train).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and got[14].lang_pred == "de" and got[10].lang_pred == "en"
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {7, 8, 9, 15} and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert langid.predict(empty).count() == 0
    assert {r.lang_pred for r in langid.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity(spark, docs, empty):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(400):
        text, bad = prose(60, 1000 + i), i % 4 == 0
        if bad:
            words = text.split(" ")
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["scum", "idiot", "loser"])
            text = " ".join(words)
        rows.append((1000 + i, text))
        marks.append((1000 + i, int(bad), 1))
    data = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    labels = spark.createDataFrame([*marks, (None, 1, 1), (1001, None, 1)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.predict(data, labels).collect()}
    test = [(i, bad) for i, bad, _ in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in test) and sum(got[i].predicted == bad for i, bad in test) >= 0.95 * len(test)
    hit = next(i for i, bad in test if bad and got[i].predicted)
    text = dict(rows)[hit].encode()
    assert any(re.search(rb"scum|idiot|loser", text[s.begin : s.end]) for s in got[hit].offending)
    assert all(0 <= got[i].score <= 1 for i, _ in ROWS) and got[8].predicted == 0
    assert toxicity.predict(empty, labels).count() == 0
    assert {r.score for r in toxicity.predict(docs, labels.where("false")).collect()} == {0.0}


def file_round(documents, frame_bytes):
    out = io.BytesIO()
    close, out.close = out.close, lambda: None
    writer = token_files.Writer(out, frame_bytes)
    for name, ids in documents:
        writer.add(name, ids)
    writer.close()
    return out


def test_token_files(docs, empty, spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(byte_file())
    wanted, at = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        wanted.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_files.round_trip(docs, byte_file()).collect()]
    key = lambda r: (r[1], r[0] or 0)
    assert sorted(got, key=key) == sorted(wanted, key=key)
    assert token_files.round_trip(empty, byte_file()).count() == 0


def test_frames_are_independent_and_checked():
    import zstandard

    documents = [(None if i == 0 else i, np.arange(i * 37 % 900, dtype="<u4").tobytes()) for i in range(50)]
    out = file_round(documents, 1024)
    data = out.getvalue()
    reader = token_files.Reader(io.BytesIO(data), len(data))
    for i in random.Random(1).sample(range(50), 50):
        assert reader.document(i) == documents[i][1] and (reader.names[i] if reader.known[i] else None) == documents[i][0]
    frame = zstandard.ZstdDecompressor().decompress(data[int(reader.place[1]) : int(reader.place[1] + reader.packed[1])])
    assert len(frame) == reader.plain[1]
    broken = bytearray(data)
    broken[int(reader.place[0]) + int(reader.packed[0]) - 3] ^= 255
    with pytest.raises(Exception):
        bad = token_files.Reader(io.BytesIO(bytes(broken)), len(broken))
        for i in range(50):
            bad.document(i)


def test_bpe(docs, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect()}
    for i, t in ROWS:
        ids = plain.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    rng = random.Random(3)
    texts = ["x" * 4000, "ab" * 2000, "".join(rng.choices("abcde", k=900)), *("".join(rng.choices("aAé' .\n9", k=rng.randint(1, 40))) for _ in range(500))]
    own = bpe.coder(path, public_tokenizers.PATTERN)
    for t, ids in zip(texts, own.code(texts), strict=True):
        assert ids.decode() == " ".join(map(str, plain.encode_ordinary(t)))
    numbers = [plain.encode_ordinary(t) for t in texts]
    assert list(own.decode([np.array(n, np.int32) for n in numbers])) == [t.encode() for t in texts]
    assert own.decoded_hashes([" ".join(map(str, n)).encode() for n in numbers]) == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    # Ids that are wrong show in what they decode to.
    wrong = b" ".join(own.code(["one two"])[0].split()[::-1])
    assert own.decoded_hashes([wrong]) != [hashlib.sha256(b"one two").hexdigest()]
    assert bpe.round_trip(empty, path, public_tokenizers.PATTERN).count() == 0


def contracted(word, ranks):
    """Byte-pair merges one at a time: the leftmost pair of minimum rank."""
    parts = [bytes([b]) for b in word]
    while found := [(ranks[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in ranks]:
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@pytest.mark.parametrize(("long", "piece", "reach"), [(0, 24, 4), (1 << 20, 24, 4), (8, 3, 1), (5, 2, 1), (0, 1, 2), (20, 7, 3)])
def test_contractions_over_random_merges(monkeypatch, long, piece, reach):
    for name, value in (("LONG", long), ("PIECE", piece), ("REACH", reach)):
        monkeypatch.setattr(bpe, name, value)
    rng = random.Random(11)
    for _ in range(6):
        tokens = {bytes([b]) for b in range(256)}
        pool = [b"a", b"b", b"c"]
        while len(pool) < 30:
            new = rng.choice(pool) + rng.choice(pool)
            if new not in tokens:
                tokens.add(new)
                pool.append(new)
        own = pool[3:]
        rng.shuffle(own)  # ranks without order: a longer token may go before its parts
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(own)}
        words = ["".join(rng.choices("abc", k=rng.randint(1, 60))) for _ in range(80)] + ["a" * n for n in range(1, 20)]
        got = bpe.Coder(ranks, r"\S+| ").code(words)
        assert got == [" ".join(map(str, contracted(w.encode(), ranks))).encode() for w in words]


def test_long_words():
    """A million mixed letters in one word, repetitions, and both: as the library codes them, in a time that follows the length."""
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(path), special_tokens={})
    rng = random.Random(12)
    own = bpe.coder(path, public_tokenizers.PATTERN)
    period = "".join(rng.choices("acgt", k=997))
    for word in ("".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDE", k=1_000_000)), "".join(rng.choices("acgt", k=100_000)), "abc" * 20_000, "a" * 50_001, period * 40, "a" * 3000 + period + "ab" * 3000, "".join(rng.choices(["the", "quick", "anti", "ization", "é", "日本"], k=5000))):
        began = time.process_time()
        assert own.code([word]) == [" ".join(map(str, plain.encode_ordinary(word))).encode()]
        assert time.process_time() - began < 60


def test_windows_do_not_change_ids(monkeypatch):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(path), special_tokens={})
    monkeypatch.setattr(bpe, "WINDOW", 50)
    monkeypatch.setattr(bpe.windows, "__defaults__", (50,))
    monkeypatch.setattr(bpe, "DECODED", 16)
    texts = [t or "" for t in TEXTS.values() if t != LONG]
    coded = bpe.coder(path, public_tokenizers.PATTERN).code(texts)
    assert coded == [" ".join(map(str, plain.encode_ordinary(t))).encode() for t in texts]
    assert bpe.coder(path, public_tokenizers.PATTERN).decoded_hashes(coded) == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def weights_of(text):
    w = (text or "").encode().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def similarity(a, b):
    keys = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[k], b[e] / b[k]) for e in keys) for k in a if k in b)


def test_probability_jaccard_and_its_estimate():
    rng = random.Random(5)
    for _ in range(20):
        a, b = (collections.Counter(rng.choices(range(30), k=40)) for _ in range(2))
        x, y = (tuple(np.array(v) for v in (sorted(c), [c[k] for k in sorted(c)])) for c in (a, b))
        assert math.isclose(minhash.probability_jaccard(x, y), similarity(a, b), rel_tol=1e-12)
    texts = [BASE + " " + prose(60, 50), BASE + " " + prose(60, 51), "one two three"]
    held = minhash.signatures([t.encode() for t in texts], 4000)
    assert abs((held[0] == held[1]).mean() - similarity(weights_of(texts[0]), weights_of(texts[1]))) < 0.03 and (held[2] != 0).all()


@pytest.mark.parametrize("one_task", [1_000_000, 0])
def test_components(spark, one_task):
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, i) for i in range(301, 340)]
    pairs = [(a, b) for a, b in pairs if a != b]
    name = lambda i: i.to_bytes(2, "big")
    got = {bytes(r[0]): bytes(r[1]) for r in minhash.components(spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in pairs], "__a binary, __b binary"), one_task).collect()}
    above = {x: x for p in pairs for x in p}
    for _ in above:
        for a, b in pairs:
            above[a] = above[b] = min(above[a], above[b])
    assert got == {name(k): name(v) for k, v in above.items()}


@pytest.mark.parametrize("rounds", (minhash.LEADER_ROUNDS, 0))
def test_near_copies(spark, docs, empty, monkeypatch, rounds):
    rng = random.Random(8)
    rows = list(ROWS)
    for i in range(60):  # copies of one text with more and more edits: chains and pairs near the threshold
        words = prose(100, 77).split(" ")
        for k in rng.sample(range(100), rng.randint(0, 3)):
            words[k] = f"e{rng.randrange(1000)}"
        rows.append((2000 + i, " ".join(words)))
    own = spark.createDataFrame(rows, "doc_id long, text string")
    counts = [weights_of(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if counts[a] and counts[b] and set(counts[a]) & set(counts[b]) and similarity(counts[a], counts[b]) >= 0.8:
            label[root(a)] = root(b)
    classes = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        classes[root(k)].append(i)
    wanted = {i: (min(c, key=lambda x: (x is None, x)), len(c)) for c in classes.values() for i in c}
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "LEADER_ROUNDS", rounds)  # none: blocks find all links that are not with a bucket's first leader
    got = {r.doc_id: (r.class_id, r.class_size) for r in minhash.classify(own).collect()}
    assert got == wanted
    kept = minhash.dedup(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {6, 7, 8, 9, 10, 11} and kept.where("doc_id in (2, 3, 4)").count() == 0
    assert minhash.classify(empty).count() == 0


def luhn(n):
    return sum((2 * d - 9 if d > 4 else 2 * d) if k % 2 else d for k, d in enumerate(map(int, reversed(n)))) % 10 == 0


def test_pseudonyms(spark, docs, empty):
    texts = [
        "card 4111 1111 1111 1111, 4111111111111111 bad 4111111111111112 end",
        "ssn 123-45-6789 and 000-12-3456, tel +1 (171) 555-2028, ip 64.147.79.24 not 999.1.1.1",
        "2024-02-29 2023-02-29 29.02.2024 02/29/2024 2024/02/29",
        'mail bob.smith24@mail4.example.com. token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"',
        "again 4111111111111111, 123-45-6789, +1 (171) 555-2028, bob.smith24@mail4.example.com",
        "no numbers here",
    ]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(own, "k").collect()}
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", got[0])
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111" and luhn(cards[1]) and cards[2] == "4111111111111112" and cards[1] in got[4]
    assert "000-12-3456" in got[1] and "999.1.1.1" in got[1] and "123-45-6789" not in got[1] and "555-2028" not in got[1] and "64.147" not in got[1]
    assert re.findall(r"\d{3}-\d{2}-\d{4}", got[1])[0] in got[4] and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1])[0] in got[4]
    iso, bad, dotted, american, slashed = got[2].split(" ")
    assert bad == "2023-02-29" and iso != "2024-02-29" and slashed == iso.replace("-", "/")
    assert dotted.split(".")[::-1] == iso.split("-") and american.split("/") == [iso[5:7], iso[8:], iso[:4]]
    assert re.fullmatch(r'mail [a-z]{3}\.[a-z]{5}\d{2}@mail4\.example\.com\. token = "[0-9a-f]{40}"', got[3]) and "bob.smith24" not in got[3] and "9c8b4543" not in got[3]
    assert got[5] == texts[5] and {r.doc_id: r.text for r in pii.pseudonymise(own, "other").collect()}[0] != got[0]
    masked = pii.mask(docs, "k").drop("__found")
    assert set(masked.columns) == set(docs.columns) and {(r.doc_id, r.text) for r in masked.collect()} == set(ROWS)
    assert pii.pseudonymise(empty, "k").count() == 0


def test_no_plan_shows_the_key(spark):
    own = spark.createDataFrame([(1, "card 4111111111111111")], "doc_id int, text string")
    masked = pii.pseudonymise(own, "it's a key")
    masked.collect()
    plans = masked._jdf.queryExecution().toString()
    assert "a key" not in plans and "LocalTableScan" in plans


def test_pseudonyms_are_permutations(spark):
    days = spark.sql("select cast(date_add(date'1800-01-01', cast(id as int)) as string) as text from range(0, 146097, 7)").withColumn("doc_id", F.lit(1))
    got = [r.text for r in pii.pseudonymise(days, "k").collect()]
    assert len(set(got)) == len(got) and all("1800-01-01" <= d <= "2199-12-31" for d in got)
    codes = spark.range(2000).selectExpr("id as doc_id", "concat(lpad(1 + id % 40, 3, '0'), '-', lpad(1 + id div 40, 2, '0'), '-0001') as text")
    got = [r.text for r in pii.pseudonymise(codes, "k").collect()]
    assert len(set(got)) == 2000 and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", c) for c in got)


def test_pipeline(docs, spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None, None, None, None), (None, BASE, None, None, None, None, None)], SCHEMA))
    langs = stages["language"](spark, docs, "")
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in langs.collect()} == {7, 8, 9, 15} and langs.columns == docs.columns
    assert sorted(r.text[:7] for r in langs.where("doc_id is null").collect()) == [BASE[:7], "no name"]
    exact = stages["exact_dedup"](spark, langs, "")
    near = stages["near_dedup"](spark, exact, "")
    assert [r.text for r in near.where("doc_id is null").collect()] == ["no name at all"]
    assert exact.where("doc_id in (1, 2)").count() == 0 and near.where("doc_id in (3, 4, 5)").count() == 1
    private = stages["pii"](spark, near, "")
    assert private.columns == docs.columns and private.count() == near.count()
    packed = stages["packing"](spark, private, "")
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in private.collect()}


def test_pipeline_rejects_unlearned_languages(spark):
    import corpus_pipeline

    rng = random.Random(5)
    rows = [(i, prose(60, i), "en") for i in range(100, 160)]
    other = ["все люди рождаются свободными и равными в своем достоинстве и правах", "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789 ", k=400))]
    docs = spark.createDataFrame([*rows, *((i, t, None) for i, t in enumerate(other))], "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == {i for i, _, _ in rows}
    assert langid.predict(docs).columns == ["doc_id", "held_out", "lang_pred", "score"]
