import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from odd_rows import ODD

from tidemark.llm import components, exact_dedup, line_dedup, near_join


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# ------------------------------------------------------------ exact


def test_exact_groups_against_brute_force(docs):
    rng = random.Random(1)
    texts = ["Same Text", "same text", "SAME TEXT", "ÄB", "äb", "", None] + [" ".join(words(rng, 5, 3)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + ODD[3:]
    norm = lambda t: (t or "").encode("utf-8", "surrogatepass").lower()
    for keep in ("largest", "smallest"):
        got = exact_dedup.duplicate_groups(docs(*rows).repartition(7), keep).collect()
        assert len(got) == len(rows)
        groups = {}
        for i, t in rows:
            groups.setdefault(norm(t), []).append(i)
        want = []
        for i, t in rows:
            ids = groups[norm(t)]
            known = [x for x in ids if x is not None]
            best = (max if keep == "largest" else min)(known) if known else None
            want.append((i, best, len(ids), i == best, hashlib.sha256(norm(t)).hexdigest()))
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_exact_rows_stay_once(docs):
    df = docs((3, "A b"), (1, "a B"), (2, "a c"), (2, "a c"), (None, "a c"), (9, None), (8, ""))
    got = exact_dedup.drop_duplicates(df.repartition(3))
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 2, 8]
    assert exact_dedup.drop_duplicates(docs()).count() == 0 and exact_dedup.duplicate_groups(docs()).count() == 0


def test_hot_text_is_folded_before_the_shuffle():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(1001), pa.int64()), pa.array(["t"] * 1000 + ["u"])], ["doc_id", "text"])
    (out,) = exact_dedup._fold([], True)(iter([batch]))
    assert out.num_rows == 2 and out.column(3).to_pylist() == [999, 1000] and out.column(4).to_pylist() == [1000, 1]


def test_exact_hot_groups(docs):
    """A text that most rows share is labelled by broadcast, all others by a join; both give whole groups."""
    rows = [(k, "Hot") for k in range(300)] + [(k, f"t{k % 40}") for k in range(300, 400)] + [(None, "hot"), (None, "alone")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.duplicate_groups(docs(*rows).repartition(5)).collect()}
    want = {(k, 0, 301, k == 0) for k in range(300)} | {(None, 0, 301, False), (None, None, 1, True)}
    for k in range(300, 400):
        same = [x for x in range(300, 400) if x % 40 == k % 40]
        want.add((k, min(same), len(same), k == min(same)))
    assert got == want


# ------------------------------------------------------------ near


def brute_links(rows):
    classes = {}
    for i, t in rows:
        if i is not None:
            classes.setdefault(tuple((t or "").lower().split()), []).append(i)
    sets = {w: ({w[k : k + 5] for k in range(len(w) - 4)} if len(w) >= 5 else {w} if w else set()) for w in classes}
    links = {w: [v for v in classes if v != w and sets[w] and sets[v] and len(sets[w] & sets[v]) / len(sets[w] | sets[v]) >= 0.8] for w in classes}
    return classes, links


def test_near_join_against_brute_force(docs):
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(25):
        base = words(rng, rng.choice([6, 40, 120]))
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    base = words(rng, 150)
    for _ in range(60):  # a group of near copies
        w = list(base)
        for _ in range(3):
            w[rng.randrange(150)] = f"y{rng.randrange(10**6)}"
        rows.append((n, " ".join(w)))
        n += 1
    rows += [(n + k, t) for k, t in enumerate(["a b c", "A  b c", "a b d", "", None])] + [(None, "a b c")]
    got = near_join.near_duplicates(docs(*rows).repartition(5)).collect()
    assert len(got) == len(rows)
    classes, links = brute_links(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    parent = {w: w for w in classes}

    def find(w):
        while parent[w] != w:
            w = parent[w]
        return w

    for w, others in links.items():
        for v in others:
            parent[find(w)] = find(v)
    smallest = {}
    for w, ids in classes.items():
        smallest[find(w)] = min(smallest.get(find(w), 10**9), min(ids))
    for w, ids in classes.items():
        for i in ids:
            r = by_id[i]
            assert (r.text_id, r.n_copies, r.class_id) == (min(ids), len(ids), smallest[find(w)])
            assert (r.n_links, r.n_linked_docs) == (len(links[w]), sum(len(classes[v]) for v in links[w]))


def test_near_join_of_blocks(docs, monkeypatch):
    """Subtrees dealt out as pairs of blocks give the same links."""
    monkeypatch.setattr(near_join, "BLOCK_DOCS", 7)
    test_near_join_against_brute_force(docs)


def test_near_documents_of_one_id(docs):
    """Two texts of one id are two documents: copies of each are found, and a clean one stays."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    df = docs((5, a), (5, b), (8, b + " end"), (9, a + " end"), (5, c))
    assert sorted((r.doc_id, r.text[:1]) for r in near_join.drop_near_duplicates(df).collect()) == [(5, "a"), (5, "b"), (5, "c")]
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in near_join.near_duplicates(df).collect()) == [(5, 5, 0), (5, 5, 1), (5, 5, 1), (8, 5, 1), (9, 5, 1)]


@pytest.mark.parametrize("block", [512, 7])
def test_forest_drops_like_counted_links(docs, monkeypatch, block):
    monkeypatch.setattr(near_join, "BLOCK_DOCS", block)
    rng, rows = random.Random(13), []
    for g in range(12):
        base = words(rng, 80)
        for k in range(rng.choice([1, 3, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                w[rng.randrange(80)] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows) - 40, " ".join(w)))
    df = docs(*rows).repartition(3)
    want = sorted(r.doc_id for r in near_join.near_duplicates(df).collect() if r.doc_id == r.class_id)
    assert sorted(r.doc_id for r in near_join.drop_near_duplicates(df).collect()) == want and len(want) < len(rows)


def test_rows_dealt_in_a_large_group_grow_with_it(spark, monkeypatch):
    """Members of one subtree of which a few are not linked to its first: rows dealt for 5,000 are some five times those for 1,000."""
    schema = "tree int, bucket long, rep binary, copies long, side int, met array<long>, blocks int"
    dealt = {}
    for n in (1000, 5000):
        blocks = -(-n // near_join.BLOCK_DOCS)
        rows = spark.createDataFrame([(0, 1, k.to_bytes(16, "big"), 1, k % blocks, [1], blocks) for k in range(n)], schema)
        left = rows.where("conv(hex(rep), 16, 10) % 50 = 7").select("tree", "bucket", "rep")
        heads, rest = near_join._heads(rows), near_join._rest(rows, left)
        assert heads.count() == n + blocks and heads.where("is_head").select("rep").distinct().count() == 1
        dealt[n] = heads.count() + rest.count()
        assert rest.where("side = -1").count() == left.count() * blocks and rest.where("side >= 0").count() == n  # each unlinked one meets all
    assert dealt[5000] < 6 * dealt[1000] and near_join._pairs_of_blocks(rows).count() == 5000 * blocks


def test_near_groups_with_members_that_are_far_from_the_first(docs, monkeypatch):
    """A chain: each text is near the next one alone, so that most are not linked to the first of their subtree."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 100])) for k in range(90)] + [(200 + k, f"alone {k} " + " ".join(words[:4])) for k in range(20)]
    want = sorted(r.doc_id for r in near_join.near_duplicates(docs(*rows)).collect() if r.doc_id == r.class_id)
    for block in (2, 5, 20):
        monkeypatch.setattr(near_join, "BLOCK_DOCS", block)
        assert sorted(r.doc_id for r in near_join.drop_near_duplicates(docs(*rows)).collect()) == want
    assert want == [0, *range(200, 220)]


def test_near_rows(docs):
    a = " ".join(f"w{k}" for k in range(60))
    df = docs((50, a), (20, a + " end"), (70, "other words that stand alone here"), (20, a + " end"), *ODD)
    ids = sorted(r.doc_id or 0 for r in near_join.drop_near_duplicates(df).collect())
    assert ids == [0, 1, 4, 5, 6, 7, 7, 20, 20, 70]  # empty texts are one class; repeated rows of a kept id stay
    assert near_join.near_duplicates(docs()).count() == 0


def test_depth_reaches_recall():
    d = near_join.depth_for()
    hit = lambda k: 1 - (1 - near_join.THRESHOLD**k) ** near_join.TREES
    assert hit(d) >= near_join.RECALL > hit(d + 1)


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 2)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent if any(x != y and find(x) == find(y) for y in parent)}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# ------------------------------------------------------------ lines


def edit_distance(a, b):
    """Levenshtein distance by columns of bits."""
    peq = {}
    for k, c in enumerate(b):
        peq[c] = peq.get(c, 0) | 1 << k
    full, top, score = (1 << len(b)) - 1, 1 << max(0, len(b) - 1), len(b)
    if not b:
        return len(a)
    pv, mv = full, 0
    for c in a:
        eq = peq.get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh, eq = (ph << 1 | 1) & full, mh << 1 & full, eq | mv
        pv, mv = mh | ~(eq | ph) & full, ph & eq
    return score


def test_edit_distance():
    assert [edit_distance(a, b) for a, b in (("kitten", "sitting"), ("", "ab"), ("ab", ""), ("flaw", "lawn"), ("abc", "abc"), ("ca", "abc"))] == [3, 2, 2, 2, 0, 3]


def similar(a, b):
    return min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) - 1e-9 and edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9


@pytest.mark.parametrize("part", [400, 3])
def test_lines_against_brute_force(docs, monkeypatch, part):
    monkeypatch.setattr(line_dedup, "PART", part)
    rng = random.Random(4)
    base = [" ".join(words(rng, rng.choice([3, 6, 14, 24]))) for _ in range(12)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(6)):
            w = rng.choice(base).split()
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = f"q{rng.randrange(1000)}"
            lines.append(rng.choice([" ".join(w), " ".join(w).upper() + "!", "  " + "  ".join(w)]))
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (None, base[5])]
    places, norms = {}, {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            n = line_dedup.normal_line(line)
            if i is not None and n:
                places[i, k] = n
                norms.setdefault(n, None)
    names = list(norms)
    found, of = line_dedup.line_blocks([n.encode().split() for n in names])
    blocks = [set(found[of == k].tolist()) for k in range(len(names))]
    parent = list(range(len(names)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            if blocks[a] & blocks[b] and similar(names[a], names[b]):
                parent[find(a)] = find(b)
    first = {}
    for place in sorted(places):
        first.setdefault(find(names.index(places[place])), place)
    want = {p for p in places if first[find(names.index(places[p]))] != p}
    got = {(r.doc_id, r.line) for r in line_dedup.duplicate_lines(docs(*rows).repartition(4)).collect()}
    assert got == want and want
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs(*rows)).collect()}
    for i, t in rows:
        lines = t.split("\n") if t else []
        kept = [x for k, x in enumerate(lines) if (i, k) not in want]
        assert (out[i].n_lines, out[i].n_dropped, out[i].text) == (len(lines), len(lines) - len(kept), "\n".join(kept))


def brute_lines(rows):
    """(doc_id, line) that go, by all pairs of distinct lines; no blocks."""
    places, norms = {}, {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            n = line_dedup.normal_line(line)
            if i is not None and n:
                places[i, k] = n
                norms[n] = n

    def find(x):
        while norms[x] != x:
            x = norms[x]
        return x

    names = list(norms)
    for a in range(len(names)):
        for b in range(a):
            if find(names[a]) != find(names[b]) and similar(names[a], names[b]):
                norms[find(names[a])] = find(names[b])
    first = {}
    for place in sorted(places):
        first.setdefault(find(places[place]), place)
    return {p for p, n in places.items() if first[find(n)] != p}


def edited(rng, w, changes, inserts=0):
    w = list(w)
    for k in rng.sample(range(len(w)), changes):
        w[k] = "".join(rng.choice("abcdefghijklmnop") for _ in w[k])
    for _ in range(inserts):
        w.insert(rng.randrange(len(w) + 1), "".join(rng.choice("abcdefghijklmnop") for _ in range(5)))
    return w


def letters_changed(rng, w, words_hit):
    """One letter changed in each of some words."""
    w = list(w)
    for k in rng.sample(range(len(w)), words_hit):
        at = rng.randrange(len(w[k]))
        w[k] = w[k][:at] + rng.choice("qrstuvwxyz") + w[k][at + 1 :]
    return w


def line_of(rng, size):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice([2, 4, 6, 8]))) for _ in range(size)]


def test_line_recall_against_all_pairs(docs):
    """Pairs of lines in two documents each, of 1 to 40 words, by the sort and number of edits; least recall 0.9, of any sort."""
    kinds = [("letters", size, n) for size in (6, 8, 12, 20, 40) for n in (1, 2, 3)]
    kinds += [("words", size, n) for size, n in ((5, 1), (7, 1), (9, 1), (20, 2), (20, 4), (40, 2), (40, 3), (40, 4))]
    kinds += [("insert", size, n) for size, n in ((9, 1), (14, 1), (15, 1), (30, 1), (40, 2))] + [("letters", 2, 1), ("letters", 1, 1)]
    rng, parts = random.Random(8), []
    for n, (sort, size, edits) in enumerate(kinds):
        part = []
        for i in range(1000 * n, 1000 * n + 80, 2):
            base = line_of(rng, size)
            if size < 3:
                base = [w + "bcdefgh" for w in base]
            other = letters_changed(rng, base, edits) if sort == "letters" else edited(rng, base, edits) if sort == "words" else edited(rng, base, 0, edits)
            part += [(i, " ".join(base)), (i + 1, " ".join(other))]
        parts.append(part)
    got = {(r.doc_id, r.line) for r in line_dedup.duplicate_lines(docs(*sum(parts, [])).repartition(3)).collect()}
    for kind, part in zip(kinds, parts):
        want = brute_lines(part)
        found = {p for p in got if p[0] // 1000 == part[0][0] // 1000}
        print(kind, len(found), len(want))
        assert found <= want and len(found) >= 0.9 * len(want) and len(want) > 10


def test_lines_without_spaces(docs):
    rng = random.Random(3)
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60))
    rows = [(1, han), (2, han[:20] + "X" + han[21:]), (3, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60)))]
    assert {(r.doc_id, r.line) for r in line_dedup.duplicate_lines(docs(*rows)).collect()} == {(2, 0)}


def test_equal_short_lines_go(docs):
    rows = [(k, f"Menu\nRead more\nown line number {'abcdefghij'[k] * 9}") for k in range(8)]
    got = {(r.doc_id, r.line) for r in line_dedup.duplicate_lines(docs(*rows)).collect()}
    assert {p for p in got if p[1] < 2} == {(k, n) for k in range(1, 8) for n in (0, 1)}


def test_a_unique_line_of_a_repeated_id_stays(docs):
    a, b = "the second line of row a stands nowhere else", "shared words that stand in two rows of the table"
    out = line_dedup.dedup_lines(docs((7, f"first of a is alone here too\n{a}"), (7, f"first of b is quite another thing\n{b}"), (1, b))).collect()
    assert {r.text for r in out} == {f"first of a is alone here too\n{a}", "first of b is quite another thing", b}


def test_large_blocks_pass_through(docs, monkeypatch):
    """Lines of a block that outgrows its task are passed on, and all links are found."""
    monkeypatch.setattr(line_dedup, "HELD", 40)
    monkeypatch.setattr(line_dedup, "LARGE", 10)
    monkeypatch.setattr(line_dedup, "PART", 5)
    rng = random.Random(12)
    start = line_of(rng, 14)
    rows = [(k, " ".join(start + line_of(rng, 20))) for k in range(60)]
    rows += [(100 + k, " ".join(letters_changed(rng, t.split(), 3))) for k, t in rows]
    assert {(r.doc_id, r.line) for r in line_dedup.duplicate_lines(docs(*rows).repartition(6)).collect()} == brute_lines(rows)


def test_near_copies_of_a_large_block_meet_its_first_line(docs, monkeypatch):
    """Lines dealt out grow with the group, not with its square, and what is linked is linked."""
    monkeypatch.setattr(line_dedup, "PART", 5)
    dealt, links = [], line_dedup._links
    monkeypatch.setattr(line_dedup, "_links", lambda groups: (dealt.append(groups.count()), links(groups))[1])
    rng = random.Random(31)
    start, rest = line_of(rng, 14), line_of(rng, 40)
    rows = [(k, " ".join([*start, *rest, f"q{chr(97 + k // 26)}{chr(97 + k % 26)}"])) for k in range(200)]
    assert {(r.doc_id, r.line) for r in line_dedup.duplicate_lines(docs(*rows)).collect()} == {(k, 0) for k in range(1, 200)}
    assert len(dealt) == 2 and sum(dealt) < 10 * 200  # pairs of parts of one block and class alone are 200 * 40


def test_distances_of_many_pairs():
    rng = random.Random(21)
    for size in (1, 5, 63, 64, 65, 128, 129, 200):
        a = ["".join(rng.choice("abcdé漢") for _ in range(size)) for _ in range(40)]
        b = ["".join(c for c in x for c in ([c] if rng.random() > 0.2 else rng.choice(["", c + "q", "z"]))) or "z" for x in a]
        assert line_dedup.distances(a, b).tolist() == [edit_distance(x, y) for x, y in zip(a, b)]
        assert line_dedup.distances(a, b, True).tolist() == [min(edit_distance(x, y[:k]) for k in range(len(y) + 1)) for x, y in zip(a, b)]
    pairs = [(b"%d" % k, b"x%d" % k, x, y, int(0.2 * max(len(x), len(y)))) for k, (x, y) in enumerate(zip(a * 3, b * 3))] + [(b"s", b"t", "abc", "abcdefgh", 1)]
    long = "".join(rng.choice("abcd ") for _ in range(900))
    pairs += [(b"l", b"m", long, long[:300] + "Q" + long[310:], 180), (b"n", b"o", long, "".join(rng.choice("abcd ") for _ in range(900)), 180)]
    found = {frozenset(p) for p in line_dedup.measured(pairs)}
    assert found == {frozenset(p[:2]) for p in pairs if edit_distance(p[2], p[3]) <= p[4]}


def test_script_cost_is_no_less_than_the_distance():
    rng, close = random.Random(6), 0
    for _ in range(300):
        a = "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 40)))
        b = "".join(c if rng.random() > 0.1 else rng.choice("abc ") for c in a)
        cost, distance = line_dedup.script_cost(a.split(" "), b.split(" "), 1e9), edit_distance(a, b)
        assert cost >= distance
        close += cost <= 3 * distance
    assert close > 100


def test_lines_of_odd_rows(docs):
    assert line_dedup.dedup_lines(docs(*ODD)).count() == len(ODD) and line_dedup.dedup_lines(docs()).count() == 0


def test_near_of_many_pairs():
    rng = random.Random(12)
    a, b, most = [], [], []
    for _ in range(150):
        x = "".join(rng.choice("abcde fgh") for _ in range(rng.randrange(1, 400)))
        y = list(x) if rng.random() < 0.8 else [rng.choice("abcde fgh") for _ in x]
        for _ in range(rng.randrange(len(x) // 3 + 1)):
            y.insert(rng.randrange(len(y) + 1), "x") if rng.random() < 0.5 or len(y) < 2 else y.pop(rng.randrange(len(y)))
        a.append(x)
        b.append("".join(y))
        most.append(len(x) // 5)
    distances = [line_dedup.edit_distance(x, y, 1e9) for x, y in zip(a, b)]
    assert line_dedup.near(a, b, np.array(most)).tolist() == [d <= m for d, m in zip(distances, most)]
    assert all(line_dedup.anchored_cost(x, y, 1e9) >= d for x, y, d in zip(a, b, distances))


def test_large_texts_are_taken_apart_in_portions(docs, monkeypatch):
    rng = random.Random(13)
    rows = [(k, "\n".join(" ".join(line_of(rng, 9)) for _ in range(4))) for k in range(30)]
    rows += [(k + 100, t) for k, t in rows]
    want = {(r.doc_id, r.line) for r in line_dedup.duplicate_lines(docs(*rows)).collect()}
    monkeypatch.setattr(line_dedup, "PORTION", 200)
    assert {(r.doc_id, r.line) for r in line_dedup.duplicate_lines(docs(*rows)).collect()} == want
    table = pa.table({"text": [t for _, t in rows]}).to_batches()
    parts = list(line_dedup._portions(iter(table), 0))
    assert len(parts) > 10 and pa.Table.from_batches(parts).equals(pa.Table.from_batches(table))


def test_counts_of_long_lines_are_made_again(docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "LONG", 20)
    monkeypatch.setattr(line_dedup, "KEPT", 1)
    rng = random.Random(14)
    start = line_of(rng, 14)
    rows = [(k, " ".join(start + line_of(rng, 3 + k % 2))) for k in range(24)]
    assert {(r.doc_id, r.line) for r in line_dedup.duplicate_lines(docs(*rows)).collect()} == brute_lines(rows)
