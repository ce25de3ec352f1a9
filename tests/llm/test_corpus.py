"""Operators that compare rows, against brute force on small corpora."""

import random
import re
import zlib

import numpy as np
import pytest

from siteglass.llm import line_dedup, near_dup, packing, repeats, tokens

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


# ---------------------------------------------------------------- line dedup


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def plain_lines(docs, p):
    seen, out = [], {}
    for d, t in sorted((d, t) for d, t in docs if d is not None and t is not None):
        gone = []
        for no, line in enumerate(t.split("\n")):
            w = line.strip(" ").split(" ")
            if len(w) >= p.min_words:
                if any(w == x or (min(len(w), len(x)) >= p.fuzzy_words and one_edit(w, x)) for x in seen):
                    gone.append(no)
                seen.append(w)
        out[d] = gone
    return out


@pytest.mark.parametrize(("seed", "p"), [(5, line_dedup.Params(3, 4)), (6, line_dedup.Params())])
def test_line_dedup(frame, seed, p):
    rng = random.Random(seed)
    vocab = [chr(97 + i) * rng.randint(1, 3) for i in range(12)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 14))] for _ in range(40)]
    docs = []
    for d in range(80):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i, kind = rng.randrange(len(w)) if w else 0, rng.random()
                if kind < 0.33 and w:
                    w[i] = rng.choice(vocab)
                elif kind < 0.66 and w:
                    del w[i]
                else:
                    w.insert(i, rng.choice(vocab))
            lines.append((" " if rng.random() < 0.9 else " \t").join(w))
        docs.append((d, "\n".join(lines)))
    docs += ODD
    want = plain_lines(docs, p)
    frame_ = frame(docs)
    out = {r.doc_id: r for r in line_dedup.dedup_lines(frame_, p).collect()}
    assert len(out) == len(docs) and sum(map(len, want.values())) > 30
    for d, t in docs:
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want.get(d, []))
        assert out[d].text == kept and out[d].n_removed == len(want.get(d, [])), d
    assert line_dedup.dedup_lines(frame_, p).columns == [*frame_.columns[:-1], "n_lines", "n_removed"]
    clean = line_dedup.clean(frame_, p)
    assert clean.columns == frame_.columns
    stays = {d for d, t in docs if not want.get(d) or "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d]).split()}
    assert {r.doc_id for r in clean.collect()} == stays


def test_line_dedup_of_nothing_and_of_repeated_rows(frame):
    assert line_dedup.digest(line_dedup.dedup_lines(frame([]))).count() == 0
    row = (1, "one two three four five six")
    assert [r.n_removed for r in line_dedup.dedup_lines(frame([row, row, (2, row[1])])).orderBy("doc_id").collect()] == [0, 0, 1]


def test_line_dedup_stays_in_sql(frame):
    plan = line_dedup.dedup_lines(frame([(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan.replace("ArrowEval", "Python"))


# ---------------------------------------------------------------- near duplicates


def shingles(t, n=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def classes(docs, words=4):
    sets = {d: shingles(t, words) for d, t in docs if d is not None}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return sets, {d: top(d) for d in ids}


@pytest.mark.parametrize("block", [1_000_000, 300])
def test_near_duplicates(frame, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", block)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(500)]
    docs = []
    for size, copies in ((6, 3), (40, 60), (90, 40), (12, 20)):
        base = [rng.choice(vocab) for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append(" ".join(w).title() if rng.random() < 0.2 else " ".join(w))
    rng.shuffle(docs)
    docs = [*enumerate(docs), *ODD]
    sets, want = classes(docs)
    got = {r.doc_id: r for r in near_dup.near_duplicates(frame(docs)).collect()}
    assert len(got) == len(docs) and len(set(want.values())) < len(want)
    for d in want:
        assert (got[d].component_id, got[d].n_shingles, got[d].kept) == (want[d], len(sets[d]), want[d] == d)
    assert got[None].component_id is None and got[None].kept


def test_near_duplicates_of_nothing_and_of_repeated_rows(frame):
    assert near_dup.near_duplicates(frame([])).count() == 0
    got = near_dup.near_duplicates(frame([(3, "a b c d e"), (3, "a b c d e"), (5, "A b c d e")])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (3, 3, True), (5, 3, False)]


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    b = np.concatenate((a[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)))
    s = near_dup.sketch([a, b, a[:1]], 600)
    assert (s != np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.08


def test_work_folders_can_be_dropped(spark, frame):
    from pathlib import Path

    from siteglass.llm import common

    folder = common.work_dir(spark)
    common.materialize(spark.range(3), folder)
    assert Path(folder).exists() and common.drop_work(spark) >= 1
    assert not Path(folder).exists() and common.drop_work(spark) == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)], "a long, b long")
    got = {r.node: r.root for r in near_dup._flat(near_dup.components(edges, near_dup.work_dir(spark)), near_dup.work_dir(spark)).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


# ---------------------------------------------------------------- repeated strings


def plain_repeats(docs, length):
    first, out = set(), {}
    for d, t in sorted((d, t or "") for d, t in docs if d is not None):
        b = t.encode()
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in first:
                mask[i : i + length] = b"\1" * length
            first.add(w)
        out[d] = bytes(x for x, m in zip(b, mask, strict=True) if not m)
    return out


@pytest.mark.parametrize(("p", "rows"), [(repeats.Params(12, 5), 1000), (repeats.Params(30, 7), 3), (repeats.Params(12, 4), 4), (repeats.Params(), 1000)])
@pytest.mark.parametrize("frequent", [False, True])
def test_repeats(frame, spark, monkeypatch, p, rows, frequent):
    if frequent:  # the runs of most minimizers are cut
        for name, value in (("SAMPLE", 1), ("LEAST_HOT", 2), ("SHARE", 1000)):
            monkeypatch.setattr(repeats, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)  # batches are a unit of the algorithm
    rng = random.Random(p.length)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(30)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(12)]
    docs = []
    for d in range(60):
        t = " ".join(rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 8)))
        kind = rng.random()
        if kind < 0.1:
            t = "a" * rng.randint(0, 300)
        elif kind > 0.8 and docs:
            t = rng.choice(docs)[1].replace("a", "b", 1)
        docs.append((3 * d, t))
    docs += ODD
    want = plain_repeats(docs, p.length)
    got = {r.doc_id: r for r in repeats.remove_repeats(frame(docs), p).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        if d is not None:
            assert bytes(got[d].kept) == want[d], d
            assert sum(s.end - s.start for s in got[d].spans) == len((t or "").encode()) - len(want[d])


def test_repeats_of_nothing_and_of_repeated_rows(frame):
    assert repeats.digest(repeats.remove_repeats(frame([]))).count() == 0
    t = "".join(chr(97 + i % 26) + str(i) for i in range(100))
    got = repeats.digest(repeats.remove_repeats(frame([(1, t), (1, t), (2, t)]))).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, len(t))]


def test_repeats_of_very_long_texts_and_long_windows(frame):
    rng = random.Random(31)
    long = "".join(rng.choice("abcdefgh") for _ in range(300_000))
    thue = "".join("ab"[i.bit_count() & 1] for i in range(4096))
    docs = [(1, long), (2, "x" + long[1000:200_000] + "y" + long[150_000:150_050]), (3, thue), (4, thue.translate({97: "b", 98: "a"})), (5, long[::-1] + thue[:2000])]
    for p in (repeats.Params(), repeats.Params(1024, 64)):
        want = plain_repeats(docs, p.length)
        got = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(frame(docs), p).collect()}
        assert got == want and len(want[2]) < 1000


def test_longest_previous_factor():
    rng = random.Random(8)
    for _ in range(30):
        t = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60)))
        want = [max([k for j in range(i) for k in range(len(t) - i + 1) if t[i : i + k] == t[j : j + k]], default=0) for i in range(len(t))]
        assert repeats.longest_previous_factor(t).tolist() == want
        for length in (1, 3, 9):
            if len(t) >= length:
                at = np.arange(len(t) - length + 1)
                assert repeats.repeated_windows(np.frombuffer(t, np.uint8), at, length).tolist() == [w >= length for w in want[: len(at)]]


# ---------------------------------------------------------------- tokens


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(VOCAB, room=2000)


def test_encoding_in_pieces_equals_encoding_at_once(encoder):
    rng = random.Random(2)
    bits = ["ab", "Zé", "é", " ", " ", "  ", "\n", " ", "'s", "1", "!", ",", ".", "\x1c", "日", "е́", "​", "-", "<|endoftext|>", "\x85", "x", "the", " of", "\r\n", "\t"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(6000)]
    for lo in range(0, len(texts), 700):
        part = texts[lo : lo + 700]
        for t, ids in zip(part, encoder.encode(part), strict=True):
            assert ids.tolist() == encoder.tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_pieces_are_told_apart_by_their_bytes():
    from tokenizers import Tokenizer

    plain, mine = Tokenizer.from_file(VOCAB), tokens.Encoder(VOCAB)
    rng = random.Random(12)
    for size in (3, 8, 9, 15, 16, 17, 511, 512, 513, 1024, 2048):
        thue = "".join("ab"[i.bit_count() & 1] for i in range(size))  # complementary words collide under polynomial hashes
        pairs = [thue, thue.translate({97: "b", 98: "a"})]
        pairs += ["".join(rng.choice("abcXYZ019_-/") for _ in range(size)) for _ in range(6)]
        texts = [f"x {w} y{w[:1]} {w}, z" for w in pairs for _ in range(2)]
        for t, ids in zip(texts, mine.encode(texts), strict=True):
            assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids, size


def test_added_tokens_in_texts_get_their_id(frame, spark):
    from tokenizers import Tokenizer

    plain, mine = Tokenizer.from_file(VOCAB), tokens.Encoder(VOCAB, room=2000)
    rng = random.Random(7)
    bits = ["<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", " ", " ", "\n", ",", ".", "é", "the", " of", "'s", "x", "日", "  "]
    texts = ["one <|endoftext|> two", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(4000))]
    for lo in range(0, len(texts), 500):
        for t, ids in zip(texts[lo : lo + 500], mine.encode(texts[lo : lo + 500]), strict=True):
            assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)
    assert mine.encode(texts[:1])[0].tolist() == [505, 220, 50256, 734]
    docs = list(enumerate(texts[:40]))
    want = [np.array([*plain.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for _, t in docs]
    got = sorted(tokens.digest(tokens.read_files(spark, tokens.write_files(frame(docs), VOCAB))).collect(), key=lambda r: r.doc_id)
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(x), zlib.crc32(x.tobytes())) for x in want]
    packed = packing.pack_documents(frame(docs), VOCAB).collect()
    assert {r.doc_id: r.doc_tokens for r in packed} == {d: len(x) for (d, _), x in zip(docs, want, strict=True)}


def test_byte_aligned_code_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1001):
        v = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype("<u4")
        control, data = tokens.pack(v)
        assert len(control) == -(-n // 4) and (tokens.unpack(control, data, n) == v).all()


def ids_of(encoder, docs):
    return {d: np.array([*encoder.tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for d, t in docs}


def some_docs():
    rng = random.Random(6)
    return [(d, " ".join(rng.choice(["of", "the", "tionable", "Éra", "x,y", "\n", "1.5"]) for _ in range(rng.choice([0, 3, 80, 2500])))) for d in rng.sample(range(10_000, 99_999), 60)] + [x for x in ODD if x[0] is not None]


def test_token_files(frame, spark, encoder, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 500)
    docs = some_docs()
    want, start = ids_of(encoder, docs), 0
    folder = tokens.write_files(frame(docs), VOCAB)
    got = {r.doc_id: r for r in tokens.digest(tokens.read_files(spark, folder)).collect()}
    for d in sorted(want):
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(want[d]), zlib.crc32(want[d].tobytes()))
        start += len(want[d])
    assert len(got) == len(docs)
    assert tokens.digest(tokens.read_files(spark, tokens.write_files(frame([]), VOCAB))).count() == 0


def test_packing_documents(frame, encoder):
    docs = some_docs()
    want = ids_of(encoder, docs)
    rows = packing.pack_documents(frame(docs), VOCAB).collect()
    at = dict.fromkeys(want, 0)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(want[r.doc_id])
        at[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : at[r.doc_id]].tobytes())
    assert at == {d: len(x) for d, x in want.items()}
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert all(n <= 1024 and n & (n - 1) == 0 for n in filled.values())
    assert packing.pack_documents(frame([]), VOCAB).count() == 0


def test_packing_conversations(spark, encoder):
    rng = random.Random(17)
    words = ["of", "the", "tionable", "Éra", "x,y", "\n", "1.5"]
    turns = [(c, t, rng.choice(["user", "assistant", "system", None]), " ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 20, 60])))) for c in range(40) for t in range(rng.randint(1, 9))]
    turns += [(77, t, "assistant" if t % 2 else "user", "the of " * rng.randint(0, 9)) for t in range(300)]  # a hot conversation
    turns += [(78, 0, "assistant", "x,y " * 400), (79, 0, "user", "x,y " * 400), (80, None, "user", None), (None, 3, "assistant", "no id")]
    frame = spark.createDataFrame([(*r, 1, "z") for r in turns], "conv_id long, turn long, role string, text string, offset int, length string").repartition(5)
    limits = packing.Limits(128, 4, 64)
    rows = packing.pack_conversations(frame, VOCAB, limits).collect()
    want = {(c, t): (np.array([*encoder.tok.encode(x or "", add_special_tokens=False).ids, 0], dtype="<u4"), r) for c, t, r, x in turns}
    at = dict.fromkeys(want, 0)
    for r in sorted(rows, key=lambda r: (r.conv_id or -1, r.turn or -1, r.start)):
        ids, role = want[r.conv_id, r.turn]
        assert r.start == at[r.conv_id, r.turn] and r.turn_tokens == len(ids) and r.loss == (r.length if role == "assistant" else 0)
        at[r.conv_id, r.turn] += r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert at == {k: len(x) for k, (x, _) in want.items()}
    filled, bound = {}, {"tokens": 0, "loss": 0}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        tokens_, loss, examples = filled.get(r.sequence_id, (0, 0, 0))
        assert r.offset == tokens_
        filled[r.sequence_id] = tokens_ + r.length, loss + r.loss, examples
    assert all(n <= 128 and loss <= 64 for n, loss, _ in filled.values())
    bound["loss"] = sum(loss > 60 and n < 100 for n, loss, _ in filled.values())
    bound["tokens"] = sum(n > 120 and loss < 40 for n, loss, _ in filled.values())
    assert all(bound.values())  # either limit is what fills some sequences
    assert packing.pack_conversations(frame.limit(0), VOCAB).count() == 0


def test_vector_packing_of_whole_examples():
    rng = random.Random(3)
    limits = packing.Limits(tokens=100, segments=4, loss=50)
    packer = packing.Packer(limits, cut=False, pool=64)
    examples = [(k, n := rng.randint(0, 60), rng.randint(0, min(n, 50))) for k in range(600)]
    placed = [p for k, n, loss in examples for p in packer.add(k, 0, n, loss)] + list(packer.finish())
    assert sorted(p[2] for p in placed) == [k for k, n, _ in examples if n]
    bins = {}
    for seq, offset, _, _, n, loss in placed:
        b = bins.setdefault(seq, [0, 0, 0])
        assert offset == b[0]
        b[0], b[1], b[2] = b[0] + n, b[1] + 1, b[2] + loss
    assert all(t <= 100 and s <= 4 and x <= 50 for t, s, x in bins.values())
    least = max(sum(n for _, n, _ in examples) / 100, sum(x for _, _, x in examples) / 50, sum(1 for _, n, _ in examples if n) / 4)
    assert len(bins) <= 1.15 * least + 2
    with pytest.raises(ValueError):
        list(packer.add("big", 0, 101, 1))
