"""Line groups, n-gram joins, fingerprints: against brute force over all pairs."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafworks.llm import common, fingerprints, line_dedup, ngram_join
from leafworks.llm import textkit as K

from .conftest import edge_docs, frame, make_docs, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def shingles(text, k):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


class Forest(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def near_groups(docs, k, num):
    sets = [(i, shingles(t, k)) for i, t in docs if i is not None]
    f = Forest()
    for n, (i, a) in enumerate(sets):
        f.find(i)
        for j, b in sets[:n]:
            both = len(a & b)
            if both and 100 * both >= num * (len(a) + len(b) - both):
                f.join(i, j)
    return {i: f.find(i) for i, _ in sets}, dict(sets)


@pytest.mark.parametrize("which", [0, 1, 2])
def test_ngram_join(spark, which):
    rows = edge_docs() if which == 2 else make_docs(which + 1, 70)
    got = ngram_join.link(frame(spark, rows)).collect()
    groups, sets = near_groups(rows, 4, 85)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == 4
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), groups[r.doc_id])


def test_keep_one(spark, docs):
    groups, _ = near_groups(make_docs(), 5, 80)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, g in groups.items() if i == g)


def test_stage_drops_near_copies(spark):
    """The pipeline's stage takes five words and 0.8: one edit in 50 words, which op3's 4 words and 0.85 don't link."""
    import corpus_pipeline

    words = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:25], "new", *words[26:]])), (3, "another text " * 9)]
    assert near_groups(rows, 5, 80)[0][2] == 1 and near_groups(rows, 4, 85)[0][2] == 2
    assert sorted(r.doc_id for r in corpus_pipeline.ngram_jaccard_join(spark, frame(spark, rows), "").collect()) == [1, 3]


def test_frequent_order_changes_nothing(spark, docs, monkeypatch):
    """Any order of n-grams has columns of every set, and gives the same groups."""
    described = ngram_join.describe(docs)
    assert described.where("kind = 0").count() == docs.count()
    few = ngram_join.frequent(described, most=500)
    assert len(few) <= 500 and len(ngram_join.frequent(described, most=0)) == 0 and (np.diff(few.astype(float)) >= 0).all()
    for last in (np.zeros(0, K.U), few):
        size = {r.doc: r["count"] for r in ngram_join.first_columns(docs, last).groupBy("doc").count().collect()}
        assert all(n >= 1 for n in size.values())
    groups, _ = near_groups(make_docs(), 4, 85)
    for most in (0, 500):
        monkeypatch.setattr(ngram_join, "FREQUENT", most)
        monkeypatch.setattr(ngram_join, "frequent", lambda described, most=most, real=ngram_join.frequent: real(described, most))
        assert {r.doc_id: r.component_id for r in ngram_join.link(docs).collect()} == groups
        monkeypatch.undo()


def test_ngram_second_step(spark, monkeypatch):
    """A link just at the threshold, whose first shared n-gram many others hold too."""
    monkeypatch.setattr(ngram_join, "frequent", lambda described: np.zeros(0, K.U))  # order by hash alone
    words = [f"w{i}" for i in range(900)]
    words = [w for _, w in sorted(zip([int(s[0]) for s in K.text_sets(pa.array(words), 1)], words, strict=True))]
    shared, own = words[16:108], words[108:]
    rows = [(i, " ".join([shared[0], *own[30 * i : 30 * i + 30]])) for i in range(20)]
    rows += [(100, " ".join(words[:8] + shared)), (101, " ".join(words[8:16] + shared))]
    groups, _ = near_groups(rows, 1, 85)
    got = {r.doc_id: r.component_id for r in ngram_join.link(frame(spark, rows), 1).collect()}
    assert groups[101] == 100 and got == groups


def test_fingerprints(spark):
    rows = [(i, t) for i, t in make_docs(4, 50)] + [(90, None), (91, ""), (92, "x")]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in fingerprints.fingerprints(df).collect()}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t, 5), shingles(edited, 5)
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(got[i].near_edited - true) < 0.15
    by_text = {}
    for i, t in rows:
        assert by_text.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint
    groups, _ = near_groups(rows, 5, 80)
    near = {r.id: r.component for r in fingerprints.near_copies(df, fingerprints.fingerprints(df)).collect()}
    assert all(near.get(i, i) == g for i, g in groups.items())


def test_unlike_signatures():
    """Pairs of a bucket: those at the edge of what a near copy's signatures can be are given, in chunks as in one piece."""
    rng = np.random.default_rng(1)
    n = fingerprints.BANDS * fingerprints.ROWS
    x = rng.integers(0, 256, n, dtype=np.uint8)
    y, z = x.copy(), x.copy()
    y[fingerprints.ALIKE :] ^= 1
    z[fingerprints.ALIKE - 1 :] ^= 2
    sigs = pa.array([v.tobytes() for v in (x, y, z, x)], pa.binary())
    names = ["bucket", "id", "size", "component", "chunk", "sig"]
    for bucket, chunk, want in ((32, [0, 0, 0, 0], [1, 2, 4]), (32, [0, 1, 1, 0], [1, 2]), (33, [0, 0, 0, 0], [])):
        batch = pa.RecordBatch.from_arrays([pa.array([bucket] * 4), pa.array([1, 2, 3, 4]), pa.array([100] * 4), pa.array([1, 2, 2, 4]), pa.array(chunk), sigs], names)
        got = [i for r in fingerprints.near_in_keys(iter([batch.slice(0, 2), batch.slice(2)])) for i in r.column(1).to_pylist()]
        assert got == want if bucket == 33 or chunk[1] == 0 else set(got) >= set(want)
    stars = [tuple(r) for b in fingerprints.stars_in_keys(iter([batch.slice(0, 2), batch.slice(2)])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert stars == [(1, 2, fingerprints.ALIKE), (1, 4, n)]


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 3000)).astype(K.U)) for _ in range(20)]
    got = K.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets))


def test_crowded_fingerprints(spark, monkeypatch):
    """A passage that many documents share, and chains of near copies: as by brute force, in chunks of four too."""
    rng, words = random.Random(7), vocabulary(5, 500)
    passage = [rng.choice(words) for _ in range(60)]
    rows = [(i, " ".join(passage + [rng.choice(words) for _ in range(rng.randint(20, 50))])) for i in range(40)]
    text = [rng.choice(words) for _ in range(120)]
    for i in range(100, 130):
        text = list(text)
        text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    df = frame(spark, rows)
    groups, _ = near_groups(rows, 5, 80)
    for crowd in (4096, 4):
        monkeypatch.setattr(fingerprints, "CROWD", crowd)
        near = {r.id: r.component for r in fingerprints.near_copies(df, fingerprints.fingerprints(df)).collect()}
        assert {i: near.get(i, i) for i in groups} == groups


def families(n, copies, seed):
    """Families of documents of 100 4-word shingles, one or two words changed in each."""
    rng = random.Random(seed)
    words = vocabulary(11, 2000)
    rows = []
    for f in range(n):
        base = [rng.choice(words) for _ in range(103)]
        for i in range(copies):
            w = list(base)
            for _ in range(rng.randint(1, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((f * copies + i, " ".join(w)))
    return rows


def test_template_families(spark):
    """Families whose n-grams are all frequent: every document gets the component that exact Jaccard gives it."""
    rows = families(12, 90, 2)
    sets = [(i, np.sort(s)) for (i, _), s in zip(rows, K.text_sets(pa.array([t for _, t in rows], pa.large_string()), 4), strict=True)]
    f = Forest()
    for n, (i, a) in enumerate(sets):
        f.find(i)
        for j, b in sets[n - n % 90 : n]:
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                f.join(i, j)
    got = {r.doc_id: r.component_id for r in ngram_join.link(frame(spark, rows).repartition(7)).collect()}
    assert got == {i: f.find(i) for i, _ in rows}


def test_fingerprint_edges(spark, edges, empty):
    got = fingerprints.fingerprints(edges).collect()
    assert len(got) == len(edge_docs()) and sum(r.near_next is None for r in got) == 1
    assert fingerprints.fingerprints(empty).count() == 0
    one = fingerprints.fingerprints(frame(spark, [(5, "a b c d e f")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.likeness("", "") == 1.0 and fingerprints.likeness("", "00") == 0.0


def norm_lines(text):
    table = {c: chr(c).lower() for c in range(65, 91)} | {c: "0" for c in range(48, 58)}
    out = []
    for line in text.split("\n"):
        kept = "".join(table.get(ord(c), c) if c.isalnum() or ord(c) > 127 else " " if c in " \t\r\x0b\x0c" else "" for c in line)
        out.append(" ".join(kept.split(" ")) if kept.strip(" ") else "")
    return [" ".join(x for x in n.split(" ") if x) for n in out]


def edits(a, b, most):
    """The edit distance, by the plain table; over ``most``, some number over it."""
    p = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        q = [i]
        for j, d in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != d)))
        p = q
        if min(p) > most:
            return most + 1
    return p[-1]


def near_lines(x, y):
    most = int(max(len(x), len(y)) * 0.1 + 1e-9)
    if min(len(x), len(y)) < 10 or abs(len(x) - len(y)) > most:
        return False
    a, b = (collections.Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (x, y))
    return (a - b).total() <= 2 * most and (b - a).total() <= 2 * most and edits(x, y, most) <= most  # an edit changes two pairs of characters


def removed(rows, meet):
    """The lines that go, if lines link that ``meet`` and are near in edits."""
    items = [(i, t, n, x) for i, t in sorted({(i, t) for i, t in rows if i is not None and t is not None}) for n, x in enumerate(norm_lines(t)) if x]
    f, texts = Forest(), sorted({x for *_, x in items})
    keys = meet(texts)
    for n, x in enumerate(texts):
        for y in texts[:n]:
            if keys[x] & keys[y] and near_lines(x, y):
                f.join(x, y)
    seen, gone = {}, {}
    for i, t, n, x in sorted(items, key=lambda r: (r[0], common_key(r[1]), r[2])):
        if (g := f.find(x)) in seen:
            gone.setdefault((i, t), set()).add(n)
        seen[g] = True
    return gone


def common_key(text):
    """Only rows that repeat a doc_id need an order of their texts; tests that use it have none such."""
    return text


def line_keys(texts):
    """The keys of each normalised line."""
    lines = line_dedup.Lines(*K.buffers(pa.array(texts, pa.large_string())))
    at, _, size = lines.hashes()
    out = {x: set() for x in texts}
    sparse = (lines.after[at] - lines.first[at]) * line_dedup.WORD_CHARS < size
    for k, m in enumerate(line_dedup.MODES):
        of = np.flatnonzero((size >= m.low) & (size <= m.high) & ~((not m.gram) & sparse) | (k == line_dedup.BY_BYTES) & sparse & (size > m.high))
        for rows, keys in line_dedup.line_keys(k, line_dedup.packed(lines.blocks(at[of], m), m.bits)):
            for i, key in zip(of[rows].tolist(), keys.tolist(), strict=True):
                out[texts[lines.doc[at[i]]]].add(key)
    return out


def test_lines(spark):
    rows = make_docs(2, 60)
    rows.append((100, rows[0][1].upper() + "\n\n--\n" + rows[1][1].replace(" ", ",  ", 1)))
    gone = removed(rows, line_keys)
    out = line_dedup.dedup_lines(frame(spark, rows))
    got = {r.doc_id: r.text for r in out.collect()}
    assert gone
    for i, t in rows:
        assert got[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ()))


def test_crowded_lines(spark, monkeypatch):
    """Many variants under the same keys, by all ways: keys that one task holds often, larger keys and small ones."""
    rng, words = random.Random(5), [f"wd{i}" for i in range(200)]
    base = [" ".join(rng.choice(words) for _ in range(24)) for _ in range(3)]
    rows = []
    for i in range(150):
        w = base[i % 3].split(" ")
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    gone = removed(rows, line_keys)
    for crowd, small, bucket in ((256, 8, 1024), (6, 3, 1024), (6, 1, 8)):
        monkeypatch.setattr(line_dedup, "CROWD", crowd)
        monkeypatch.setattr(line_dedup, "SMALL", small)
        monkeypatch.setattr(line_dedup, "BUCKET", bucket)
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
        assert {i for i, t in got.items() if not t} == {i for i, _ in gone}


def lines_of(spark, sf_dir, n):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").orderBy("doc_id").limit(n).collect()]
    return sorted({x for t in texts for x in norm_lines(t) if len(x) >= 10})


def test_line_recall(spark, sf_dir):
    """Of the lines within the edit distance, by the plain table over all pairs, at least 0.9 meet in every class of length."""
    rng, lines = random.Random(3), lines_of(spark, sf_dir, 200)
    some = rng.sample(lines, 600)
    some += [" ".join(x.split(" ")[: rng.randint(2, 8)]) for x in rng.sample(lines, 200)]
    some = [x for x in some if len(x) >= 10]

    def change(x):
        i = rng.choice([i for i, c in enumerate(x) if c != " "])
        return x[:i] + "q" + x[i + 1 :]

    pairs = [(x, change(x)) for x in some]
    size = np.array([len(x) for x in lines])
    order = np.argsort(size, kind="stable")
    bags = np.stack([np.bincount(np.frombuffer(x.encode(), np.uint8), minlength=256) for x in lines]).astype(np.float32)
    for at, i in enumerate(order):
        js = order[at + 1 : np.searchsorted(size[order], size[i] / 0.9 + 1, "right")]
        for j in js[np.abs(bags[js] - bags[i]).sum(axis=1) <= 0.2 * size[js] + 8] if len(js) else []:
            if near_lines(lines[i], lines[int(j)]):
                pairs.append((lines[i], lines[int(j)]))
    keys = line_keys(sorted({x for p in pairs for x in p}))
    for low, high in ((1, 10), (10, 20), (20, 50), (50, 10**9)):
        of = [bool(keys[x] & keys[y]) for x, y in pairs if x != y and low <= len(x.split(" ")) < high]
        assert len(of) > 50 and np.mean(of) >= 0.9, (low, len(of), np.mean(of))


def test_repeated_ids_lose_nothing(spark):
    rows = [(1, "the common line of words"), (2, "the common line of words"), (2, "a unique line that stands nowhere else"), (2, "a unique line that stands nowhere else")]
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    assert got == [(1, rows[0][1]), (2, ""), (2, rows[2][1]), (2, rows[2][1])]


def test_very_long_lines(spark):
    """No length changes the measure: one word of 100,000 characters, and as many words."""
    a, b = "x" * 60_000 + "abc" * 20_000, " ".join(vocabulary(9, 300)) * 60
    rows = [(1, a), (2, a[:50_000] + "y" + a[50_001:]), (3, b), (4, b.replace(" ", " q ", 3)), (5, "z" * 100_000)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert [i for i, t in sorted(got.items()) if not t] == [2, 4]


def test_clashing_columns(spark, edges):
    """Columns of the names that operators use inside pass unchanged."""
    names = ["slot_", "bits_", "word_", "there_", "row_", "w", "b", "at", "there", "tk", "k_", "lines", "c0", "id", "key", "n_removed_", "component"]
    rows = [(i, f"the same line of words\nline {'abcde'[i]} {'fghij'[i] * 9}", *[f"{n}{i}" for n in names]) for i in range(3)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    for out in (line_dedup.dedup_lines(df), ngram_join.keep_one(df)):
        assert out.columns == df.columns
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]


def test_lines_a_tenth_apart(spark):
    """20 and 18 characters, two edits apart, are just similar enough."""
    rows = [(1, "a " * 9 + "bb"), (2, "a " * 8 + "bb")]
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()} == {1: rows[0][1], 2: ""}


def test_line_edges(spark, edges, empty):
    out = line_dedup.dedup_lines(edges)
    assert out.columns == edges.columns and out.count() == len(edge_docs())
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] is None and got[None] == "a null id here with six words" and got[3] == " \n\t\n" and got[9] == "" and got[4] == "one"
    assert line_dedup.dedup_lines(empty).count() == 0


def test_edit_distance():
    rng = random.Random(1)
    pairs = [tuple("".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(2)) for _ in range(600)]
    pairs += [(a, "".join(c if rng.random() > 0.1 else rng.choice("abcdé") for c in a)) for a in ("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 200))) for _ in range(300))]
    bounds = [rng.randint(0, 1 + len(a) // 5) for a, _ in pairs]
    want = [edits(a, b, k) <= k for (a, b), k in zip(pairs, bounds, strict=True)]
    assert line_dedup.within(pairs, bounds).tolist() == want == line_dedup.within(pairs, bounds, cells=64).tolist() and 100 < sum(want) < 800
    a = "x" * 1000 + "abc" + "y" * 1000
    assert line_dedup.within([(a, a.replace("b", ""))] * 2, [1, 0]).tolist() == [True, False]
    assert line_dedup.trimmed("abXcd", "abYZcd") == ("X", "YZ") and line_dedup.trimmed("aa", "aaa") == ("", "a")


def test_majority():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 700, 50)
    x, first = rng.integers(0, 1 << 32, size.sum(), dtype=np.uint32), np.cumsum(size) - size
    got = line_dedup.majority(x, first, size)
    for i, (a, n) in enumerate(zip(first, size, strict=True)):
        assert got[i].tolist() == [2 * sum(int(v) >> j & 1 for v in x[a : a + n]) > n for j in range(32)]


def test_large_buckets(monkeypatch):
    """Bounds from distances to one line leave out no pair that joins components, alone or with small buckets."""
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(120))
    rows = []
    for bucket in range(3):
        for i in range(60):
            t = list(base)
            for _ in range(rng.randint(0, 16)):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            rows.append((bucket, bucket, bucket * 1000 + i, bucket * 1000 + i, 0, [bucket], "".join(t)))
    names = ["bucket", "key", "id", "component", "chunk", "keys", "norm"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([*[(n, pa.int64()) for n in names[:5]], ("keys", pa.list_(pa.int64())), ("norm", pa.string())]))
    for together, few in ((8, 32), (1 << 13, 32), (1 << 13, 64)):
        monkeypatch.setattr(line_dedup, "TOGETHER", together)
        monkeypatch.setattr(line_dedup, "FEW", few)
        f, want = Forest(), Forest()
        for b in line_dedup.links_in_keys(iter([batch.slice(0, 70), batch.slice(70)])):
            for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                f.join(x, y)
        for k in range(3):
            own = rows[60 * k : 60 * k + 60]
            for n, x in enumerate(own):
                for y in own[:n]:
                    if edits(x[6], y[6], 12) <= 12:
                        want.join(x[2], y[2])
        assert [f.find(r[2]) for r in rows] == [want.find(r[2]) for r in rows]


def test_few_comparisons_join_a_large_component(monkeypatch):
    """Of two components in a bucket that link, few pairs are compared; pairs that don't link all are."""
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh") for _ in range(200))
    other = "".join(rng.choice("abcdefgh") for _ in range(200))
    near = lambda t: "".join(rng.choice("xyz") if rng.random() < 0.02 else c for c in t)
    norms = [near(base) for _ in range(200)] + [near(other)]
    comps = [0] * 100 + [1] * 100 + [2]
    names = ["bucket", "key", "id", "component", "chunk", "keys", "norm"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, (7, 7, i, c, 0, [7], n), strict=True)) for i, (c, n) in enumerate(zip(comps, norms, strict=True))], pa.schema([*[(n, pa.int64()) for n in names[:5]], ("keys", pa.list_(pa.int64())), ("norm", pa.string())]))
    seen = []
    whole = line_dedup.similar
    monkeypatch.setattr(line_dedup, "similar", lambda pairs: seen.extend(pairs) or whole(pairs))
    links = [x for b in line_dedup.links_in_keys(iter([batch])) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(links) == 1 and {comps[i] for i in links[0]} == {0, 1}
    apart = [p for p in seen if norms[-1] in p]
    assert len(apart) == 200 and len(seen) - len(apart) < 100


def test_columns_of_the_table():
    """Pairs compared by themselves get the distances of the plain table."""
    rng = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé日") for _ in range(rng.randint(1, 70))) for _ in range(2))
        k = rng.randint(max(0, abs(len(a) - len(b))), 80)
        assert min(line_dedup.by_columns(a, b, k), k + 1) == min(edits(a, b, 200), k + 1)


@pytest.mark.parametrize("lanes,table", [(1 << 11, 1 << 22), (5, 1 << 22), (1 << 11, 2000)])
def test_lanes_of_the_table(monkeypatch, lanes, table):
    """Pairs compared side by side get the distances of the plain table, whatever their lengths, bounds and alphabets."""
    rng = random.Random(7)
    pairs, bounds = [], []
    for _ in range(120):
        a = "".join(rng.choice("abcé日 ") for _ in range(rng.choice([rng.randint(0, 9), rng.randint(1, 260)])))
        b = list(a)
        for _ in range(rng.randint(0, 1 + len(a) // 4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 2)] = rng.choice(["", "a", "xy", "é"])
        pairs.append((a, "".join(b)) if rng.random() < 0.5 else ("".join(b), a))
        bounds.append(rng.choice([rng.randint(0, 63), 64, rng.randint(0, 200)]))
    for name, value in (("LANE", 0), ("LANE_PAIR", 0), ("LANES", lanes), ("TABLE", table)):
        monkeypatch.setattr(line_dedup, name, value)
    assert line_dedup.distances(pairs, bounds).tolist() == [min(edits(a, b, 600), k + 1) for (a, b), k in zip(pairs, bounds, strict=True)]


def test_a_large_component_comes_once(spark, monkeypatch):
    """Lines of a large component and those near it don't come once for each key."""
    monkeypatch.setattr(line_dedup, "edit_links", lambda texts, pairs: pairs)

    def rows_alone(run):
        def rows(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("id")), b.column(b.schema.get_field_index("id"))], ["a", "b"])

        return rows if run.__name__.startswith("links_") else run

    monkeypatch.setattr(line_dedup, "released", rows_alone)
    texts = spark.createDataFrame([(i, f"line {i}") for i in range(105)], "id long, norm string")
    entries = spark.createDataFrame([(k, i) for k in range(15) for i in range(105)], "key long, id long")
    groups = spark.createDataFrame([(i, 0) for i in range(100)], "id long, component long")
    none = spark.createDataFrame([], "a long, b long, n long")
    seen = [r.a for r in line_dedup.unsettled_links(texts, none, entries, groups).collect()]
    assert set(seen) == set(range(105)) and len(seen) < 200


def test_links_to_homes():
    """Of guests and lines at home that share a key, those that join components are linked; others aren't compared."""
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh ") for _ in range(120))
    rows = []
    for i in range(160):
        t = list(base)
        for _ in range(rng.randint(0, 14)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((i // 80, i % 80 >= 60, i, i if i % 80 >= 60 else -1 - i // 80, sorted(rng.sample(range(8), 2)), "".join(t)))
    names = ["bucket", "guest", "id", "component", "keys", "norm"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema(list(zip(names, kinds, strict=True))))
    pairs = [(x, y) for x in rows for y in rows if x[0] == y[0] and x[1] and not y[1] and set(x[4]) & set(y[4]) and edits(x[5], y[5], 12) <= 12]
    got = [x for b in line_dedup.links_to_homes(iter([batch.slice(0, 90), batch.slice(90)])) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert {tuple(sorted(x)) for x in got} <= {tuple(sorted((x[2], y[2]))) for x, y in pairs} and len(got) == len({x[2] for x, _ in pairs})
    assert {x[2] for x, _ in pairs} == {x for p in got for x in p if rows[x][1]}


def test_lines_of_large_components(spark, monkeypatch):
    """As they come to components of several lines, whole or in chunks, the lines that stay are those of all pairs."""
    rng, words = random.Random(11), [f"wd{i}" for i in range(200)]
    base = [" ".join(rng.choice(words) for _ in range(24)) for _ in range(2)]
    rows = []
    for i in range(160):
        w = base[i % 2].split(" ")
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    gone = removed(rows, line_keys)
    for home, bucket in ((64, 1024), (3, 1024), (3, 8)):
        monkeypatch.setattr(line_dedup, "HOME", home)
        monkeypatch.setattr(line_dedup, "BUCKET", bucket)
        monkeypatch.setattr(line_dedup, "SMALL", 3)
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
        assert {i for i, t in got.items() if not t} == {i for i, _ in gone}


def test_filters_grow_with_their_ids(spark):
    """A filter of many ids isn't crowded, and drops none."""
    assert [common.filter_bits(n) for n in (0, 1 << 20, 3 << 21, 1 << 40)] == [1 << 24, 1 << 24, 1 << 26, 1 << 26]
    some, rest = common.split_by(spark.range(1000), "id", spark.range(0, 1000, 7), 1 << 26)
    assert {r.id for r in some.collect()} == set(range(0, 1000, 7)) and rest.count() == 1000 - 143


def test_lengths_and_texts(spark):
    """Lines apart by their lengths make no link, and the texts of many lines are normalised at once."""
    texts = spark.createDataFrame([(1, "abcdefghij", 10), (2, "abcdefghijkl", 12), (3, "abcdefghiX", 10)], "id long, norm string, size long")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert [tuple(r) for r in line_dedup.edit_links(texts, pairs).collect()] == [(1, 3)]
    lines = line_dedup.Lines(*K.buffers(pa.array(["Some  Words, here\n\n x é9 \n", "one"])))
    assert lines.texts(lines.hashes()[0]) == ["some words here", "x é0", "one"]


def test_components(spark):
    rng = random.Random(3)
    for n in (0, 1, 40, 200):
        edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(n)] + ([(i, i + 1) for i in range(100, 160)] if n > 1 else [])
        f = Forest()
        for a, b in edges:
            f.join(a, b)
        want = {x: f.find(x) for a, b in edges if a != b for x in (a, b)}
        got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == want


def test_bitmap(spark):
    ids = spark.range(0, 5000, 7)
    bits = common.bitmap(ids.select(common.slot(F.col("id"))))
    slots = spark.range(5000).select("id", common.slot(F.col("id")).alias("s")).toPandas()
    hit = common.has(bits, slots["s"].to_numpy())
    assert hit[slots["id"] % 7 == 0].all() and hit.mean() < 0.2
