"""Token files, tokenizer alignment and runs of words against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from odd_rows import ODD

from tidemark.llm import alignment, queries, range_coder, runs, token_files
from tidemark.llm.tokens import load_tokenizer, tokenizer_path

DIR = "/root/testdata/sf0.001"
WORDS = "a the of and stone-age don't 3,14 Ünïcode 東京 😀 naïve x_1 <|endoftext|> ...   \n \t ﬁ é".split(" ")
TEXTS = ["", "one", "two  spaces here ", " lead", "line\nbreak \n x", "▁ marked", "tab\tand\r\nmore", "a  b", "é x", "ΑΣ ΑΣΑ"]


def texts(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return TEXTS + [r.choice([" ", " ", "  ", "\n"]).join(r.choice(WORDS) for _ in range(r.randint(1, 40))) for _ in range(n)]


# ---------------------------------------------------------------- token files


@pytest.mark.parametrize("shape", [(1, 1), (3, 700), (70, 40)])
def test_coder_gives_back_all_ids(shape):
    rng = np.random.default_rng(3)
    for ids in (np.zeros(shape, np.int64), np.full(shape, 49407), rng.integers(0, 49408, shape), np.minimum(rng.geometric(0.02, shape), 49000)):
        for fitted in (ids.reshape(-1), np.zeros(1, np.int64)):  # a prior that fits, and one that never saw the ids
            prior = range_coder.Prior.of(fitted, 49408)
            assert (range_coder.decode(range_coder.encode(ids, prior), shape[1], prior) == ids).all()


def test_coder_predicts_by_context():
    rng = np.random.default_rng(4)
    drawn = rng.integers(0, 5000, (8, 1024))
    follows = drawn % 10
    for k in range(3, 1024, 2):  # every other id follows from the two before
        follows[:, k] = 100 + (follows[:, k - 1] * 7 + follows[:, k - 2]) % 10
    size = lambda x: sum(map(len, range_coder.encode(x, range_coder.Prior.of(x.reshape(-1), 49408))))
    assert size(follows) < 0.85 * size(rng.permuted(follows, axis=1)) and size(drawn % 10) < 0.4 * size(drawn)
    assert size(np.tile(drawn[:, :64], (1, 16))) < 0.5 * size(drawn)


def test_damage_is_found():
    content = b"".join(r + b"\n" for r in token_files.write_segment(0, 49408, [(1, np.arange(3000)), (None, np.array([1]))]))
    ((shard, names, sizes, ids),) = token_files.read_file(content)
    assert (shard, names, sizes.tolist(), len(ids)) == (0, [1, None], [3000, 1], 3001) and (ids[:3000] == np.arange(3000)).all()
    for at in (3, 9, 40, len(content) // 2, len(content) - 3):
        with pytest.raises(token_files.DamagedFile):
            list(token_files.read_file(content[:at] + bytes([content[at] ^ 1]) + content[at + 1 :]))


def expected_index(rows):
    tok, at, out = load_tokenizer("word_bpe_49k.json"), 0, []
    for key, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_index(spark, docs):
    rows = [(k * 7 % 101, t) for k, t in enumerate(texts(60, 1))]
    got = token_files.token_index(docs(*rows)).collect()
    assert sorted(map(tuple, got)) == expected_index(sorted(rows))
    assert token_files.token_index(docs()).collect() == []


def test_token_index_of_odd_rows(spark, docs):
    got = [tuple(r) for r in token_files.token_index(docs(*ODD)).orderBy("start").collect()]
    keys = [r[0] for r in got]
    assert keys == sorted((k for k, _ in ODD if k is not None)) + [None]
    alone = Counter((key, n, crc) for key, t in ODD for _, _, n, crc in expected_index([(key, t)]))
    assert Counter((k, n, c) for k, _, n, c in got) == alone and got[-1][1] + got[-1][2] == sum(r[2] for r in got)
    path = token_files.new_path(spark, "again")
    token_files.write_token_files(docs((5, "the end"), (4, None)), path)
    assert {r.doc_id: r.ids for r in token_files.read_token_files(spark, path, with_ids=True).collect()} == {4: [1], 5: [*load_tokenizer("word_bpe_49k.json").encode("the end").ids, 1]}


def test_token_index_of_a_table(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in queries.QUERIES["op11_token_files"](spark, DIR).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == expected_index(rows)


# ---------------------------------------------------------------- alignment


def aligned_by_hand(rows):
    """The contract, token by token over whole texts."""
    import sentencepiece

    a_tok, b_tok = load_tokenizer("byte_bpe_50k.json", True), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    letters = alignment._byte_alphabet()
    a_names = {i: p for p, i in a_tok.get_vocab().items()}
    piece = lambda i: bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()

    def spans(ids, of):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(of(i)), i))
            at += len(of(i))
        return out

    links, out = [], {}
    for n, (key, text) in enumerate(rows):
        raw = (" " + (text or "")).encode()
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        of_a = lambda i: bytes(letters[c] for c in a_names[i])
        if not text or b"".join(map(of_a, a)) != raw or b"".join(map(piece, b)) != raw:
            out[n] = (key, 0, 0, 0, [], "")
            continue
        a, b = spans(a, of_a), spans(b, piece)
        common = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, last = [], 0
        for end in common:
            inside = lambda t: ",".join(str(i) for s, e, i in t if last < e <= end)
            groups.append(f"{inside(a)}|{inside(b)}")
            last = end
        mine = [(x, y) for s, e, x in a for t, f, y in b if max(s, t) < min(e, f)]
        links += mine
        out[n] = (key, len(a), len(b), len(groups), mine, hashlib.sha256(";".join(groups).encode()).hexdigest())
    count = Counter(links)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(k, x, y, g, len(m), sum(count[p] == best[p[1]] for p in m), sum(count[p] for p in m), s) for k, x, y, g, m, s in out.values()], count


def sort(rows):
    return sorted(rows, key=str)


def test_alignment_by_hand(spark, docs):
    rows = list(enumerate(texts(80, 2))) + [(None, "no id"), (7, "one"), (7, "one"), (8, None)]
    want, count = aligned_by_hand(rows)
    got, pairs = alignment.align_tokenizers(docs(*rows))
    assert sort(map(tuple, got.collect())) == sort(want)
    assert {(r.pair >> 16, r.pair & 65535): r.n for r in pairs.collect()} == count
    assert alignment.align_tokenizers(docs())[0].collect() == []


def test_alignment_of_blocks_agrees(spark, docs, monkeypatch):
    rows = list(enumerate(texts(50, 9)))
    monkeypatch.setattr(alignment, "BLOCK_WORDS", 100)
    monkeypatch.setattr(alignment, "MEMO_WORDS", 5)
    assert sort(map(tuple, alignment.align_tokenizers(docs(*rows))[0].collect())) == sort(aligned_by_hand(rows)[0])


def test_alignment_of_odd_rows_and_of_a_table(spark, docs):
    got, _ = alignment.align_tokenizers(docs(*ODD))
    by_id = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(ODD) and tuple(by_id[1])[1:] == tuple(by_id[2])[1:] == (0, 0, 0, 0, 0, 0, "") and by_id[3].n_links > 0
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").where("length(text) < 3000").select("doc_id", "text").collect()]
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    assert sort(map(tuple, alignment.align_tokenizers(whole)[0].collect())) == sort(aligned_by_hand(rows)[0])


# ---------------------------------------------------------------- runs


def runs_by_hand(x):
    found = set()
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i < len(x) - q:
            s = i
            while i < len(x) - q and x[i] == x[i + q]:
                i += 1
            n = i - s + q
            if i > s and n >= max(6, 4 * q) and not any(all(x[s + j] == x[s + j + p] for j in range(n - p)) for p in range(1, q)):
                found.add((s, n, q))
            i += i == s
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic(r: random.Random, most: int = 60) -> list[bytes]:
    x: list = []
    while len(x) < r.randint(0, most):
        p = r.randint(1, 9)
        x += x[-p:] * r.randint(1, 6) if x and r.random() < 0.4 else [r.choice((b"a", b"b", b"c"))]
    return x


def test_runs_against_all_stretches():
    r = random.Random(11)
    for _ in range(1500):
        x, y = periodic(r), periodic(r, 20)
        assert runs._all_runs([x, y]) == [runs_by_hand(x), runs_by_hand(y)]
    fib = [b"a", b"ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    x = [bytes([c]) for c in fib[-1] * 4]
    assert runs._all_runs([x]) == [runs_by_hand(x)]


def test_runs_without_zones_agree():
    """The bound that leaves stretches out loses nothing: the automaton over whole texts finds the same."""
    r = random.Random(12)
    for _ in range(300):
        x = periodic(r, 120)
        number = {w: k for k, w in enumerate(dict.fromkeys(x))}
        codes = np.array([number[w] for w in x], np.int32)
        assert runs.runs_of(codes, [(0, len(x))] if x else []) == runs_by_hand(x)


def test_run_rows(spark, docs):
    r = random.Random(13)
    words = [periodic(r) for _ in range(40)]
    rows = [(k, r.choice(["\t", " ", "\n\x0b "]).join(w.decode() for w in x)) for k, x in enumerate(words)]
    got = {row.doc_id: row for row in runs.find_runs(docs(*rows)).collect()}
    for (k, _), x in zip(rows, words):
        want, row = runs_by_hand(x), got[k]
        assert [(a.start, a.length, a.period) for a in row.runs] == want and row.n_runs == len(want)
        gone = {j for s, n, q in want for j in range(s + q, s + n)}
        kept = b" ".join(w for j, w in enumerate(x) if j not in gone)
        assert row.collapsed.encode() == kept and row.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        if want:
            s, n, q = max(want, key=lambda v: (v[1], -v[0], -v[2]))
            assert (row.start, row.length, row.period, row.exponent_milli) == (s, n, q, 1000 * n // q)
        else:
            assert (row.start, row.length, row.period, row.exponent_milli) == (None,) * 4


def test_runs_of_odd_rows(spark, docs):
    got = runs.find_runs(docs(*ODD), full=False).collect()
    assert len(got) == len(ODD) and runs.find_runs(docs()).collect() == []
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.collapsed_sha256 == empty and r.n_runs == 0 for r in got if r.doc_id in (1, 2, 3))
    assert [(r.start, r.length, r.period) for r in got if r.doc_id == 6] == [(0, 30_000, 1)]


def test_op13_plants_runs(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op13_periodic_runs"](spark, DIR).collect()}
    assert len(got) == len(rows)
    n_checked = 0
    for r in rows:
        words = (r.text or "").encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n < 1500:
            want = runs_by_hand(words)
            n_checked += bool(want)
            assert got[r.doc_id].runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in want).encode()).hexdigest()
    assert n_checked
