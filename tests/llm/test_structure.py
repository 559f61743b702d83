"""Conversation repair, vector codes and near vectors against brute force."""

import functools
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from leafworks.llm import chat_repair, vector_codes, vector_dedup

TURNS = "conv_id long, turn long, role string, text string, first string, cost string, audit string, copies string"


def talk(seed=0, n=120):
    """Conversations with all kinds of faults, null values, ties, and a long one."""
    rng = random.Random(seed)
    texts = ["Well, yes.", "No!", "And so on", "", " \n", "Is it?", None, "Very well. ", "é日本。", "cut off,"]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), rng.choice(texts)) for c in [None, *range(n)] for _ in range(rng.randint(1, 7))]
    rows += [(900, t, "user" if t % 2 == 0 or t % 17 == 0 else "assistant", f"turn {t}" + ("." if t % 5 else "")) for t in range(0, 400)]
    rows += [(901, 3, "user", "the same.")] * 90
    rng.shuffle(rows)
    return rows


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], TURNS).repartition(5)


def ordered(rows):
    """Rows of each conversation as the operator orders them."""
    out = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        out.setdefault(c, []).append((t is not None, t or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    return {c: sorted(x) for c, x in out.items()}


def brute_repair(rows):
    """The plain table: from the end, the least (cost, audit) for each state, insertions one at a time."""
    white, seen, kinds = " \t\n\x0b\x0c\r", set(), []
    counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, _, role, _, text in rows:
        fault = None
        if not text.strip(white):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif text.rstrip(white)[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        kinds.append(fault)
        if fault:
            counts[fault] += 1
    go = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.cache
    def best(i, state, inserts=0):
        options = []
        if i == len(rows):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            more = best(i + 1, state)
            options.append((more[0] + 3, "D" + more[1], more[2]))
            if kinds[i] in (None, "truncated"):
                extra, role, text = kinds[i] == "truncated", rows[i][2], rows[i][4]
                if (state, role[:1]) in go:
                    more = best(i + 1, go[state, role[:1]])
                    options.append((more[0] + extra, "K" + more[1], (f"{role}:{text}", *more[2])))
                new = "assistant" if state == "u" else "user"
                more = best(i + 1, new[0])
                options.append((more[0] + 2 + extra, "R" + more[1], (f"{new}:{text}", *more[2])))
        if inserts < 3:
            new = "assistant" if state == "u" else "user"
            more = best(i, new[0], inserts + 1)
            options.append((more[0] + 2, "I" + more[1], (f"{new}:", *more[2])))
        return min(options) if options else (math.inf, "", ())

    for i in range(len(rows), 0, -50):  # so that recursion stays shallow
        for state in ("", "s", "u", "a"):
            best(i, state)
    cost, audit, out = best(0, "")
    set_ = [t for known, t, *_ in rows if known]
    gaps = max(set_) - min(set_) + 1 - len(set(set_)) if set_ else 0
    first = [r[2][:1] for r in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(first, first[1:], strict=False))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, "\n".join(out)


@pytest.mark.parametrize("block", [3, 512])
def test_repair(spark, block):
    rows = talk()
    df = turns_frame(spark, rows)
    plans = chat_repair.plans(df, block).cache()
    texts = chat_repair.repaired_rows(df, plans.select("conv_id", "audit"))
    out = {}
    for r in sorted(texts.collect(), key=lambda r: r["place"]):
        out.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    sums = {r["conv_id"]: r["repaired_sha256"] for r in chat_repair.digests(texts).collect()}
    want = {c: brute_repair(x) for c, x in ordered(rows).items()}
    got = plans.collect()
    assert {r["conv_id"] for r in got} == set(want) and len(got) == len(want)
    for r in got:
        gaps, blank, duplicate, truncated, illegal, cost, audit, text = want[r["conv_id"]]
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) == (gaps, blank, duplicate, truncated, illegal, cost, audit)
        assert "\n".join(out.get(r["conv_id"], [])) == text
        assert sums.get(r["conv_id"], hashlib.sha256(b"").hexdigest()) == hashlib.sha256(text.encode()).hexdigest()
    plans.unpersist()


def test_search_is_exact_for_any_rows():
    """Whole search, and search in two blocks, against the plain table."""
    rng = random.Random(7)
    for _ in range(300):
        rows = [(rng.choice("suaxt"), rng.randrange(3)) for _ in range(rng.randint(0, 7))]
        plain = [(True, i, {"s": "system", "u": "user", "a": "assistant"}.get(r, r), "", ["Yes.", "cut", ""][k] + (f"{i}." if k == 0 else str(i) if k == 1 else "")) for i, (r, k) in enumerate(rows)]
        *_, cost, audit, _ = brute_repair(plain)
        (whole,) = chat_repair.search(rows, chat_repair.START, True).values()
        assert whole == (cost, audit)
        cut, state = rng.randint(0, len(rows)), {chat_repair.START: (0, "")}
        for piece in (rows[:cut], rows[cut:]):
            state = chat_repair.after(state, [{"a": a, "b": b, "cost": c, "audit": t} for a in range(4) for b, (c, t) in chat_repair.search(piece, a, False).items()])
        assert min(state[s] for s in chat_repair.ENDS if s in state) == (cost, audit)


def test_repair_query(spark, tmp_path):
    rows = talk(3, 200)
    turns_frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat_repair.query(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    hurt = []
    for c, t, role, text in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if d == 1 else "".join(x for x in text if x not in ".!?") if d == 2 else text
        hurt += [(c, t, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    want = {c: brute_repair(x) for c, x in ordered(hurt).items()}
    assert len(want) < len(got)  # some lost all rows
    for c, r in got.items():
        gaps, blank, duplicate, truncated, illegal, cost, audit, text = want.get(c, (0, 0, 0, 0, 0, 0, "", ""))
        assert tuple(r)[1:] == (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_repair_of_nothing(spark, tmp_path):
    turns_frame(spark, []).write.parquet(f"{tmp_path}/conversations.parquet")
    assert chat_repair.query(spark, str(tmp_path)).collect() == []
    far = turns_frame(spark, [(1, -(2**63), "user", "A."), (1, 2**63 - 1, "assistant", "x " * 500_000 + "B.")])
    (row,) = chat_repair.plans(far).collect()
    assert row["gaps"] == 2**63 - 1 and row["audit"] == "KK"


VECTORS = "vec_id long, embedding array<{}>, label int, code string, error string, x string, node string"


def vectors_frame(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], VECTORS.format(kind)).repartition(4)


def families(seed=1, n=300, dims=32):
    """Random vectors, families of near ones, copies, scaled copies, and a chain of links."""
    rng = np.random.default_rng(seed)
    x = [*rng.normal(size=(n, dims))]
    for size, noise in ((60, 0.02), (25, 0.05), (90, 0.12)):
        x += [*(rng.normal(size=dims) + noise * rng.normal(size=(size, dims)))]
    x += [x[5]] * 20 + [x[6] * 3, x[6] * 1e-12]
    a, b = np.linalg.qr(rng.normal(size=(dims, 2)))[0].T
    x += [math.cos(t) * a + math.sin(t) * b for t in np.arange(0, 6) * 0.44]
    order = rng.permutation(len(x))
    return [(int(i), [float(np.float32(v)) for v in x[j]], int(j % 5) if j % 7 else None) for i, j in enumerate(order)]


def brute_links(rows, least=0.9):
    known = [(i, np.array(x, float)) for i, x, _ in rows if i is not None and x is not None and None not in x and np.isfinite(x).all() and np.any(np.array(x) != 0)]
    links = {i: 0 for i, _, _ in rows}
    root = list(range(len(known)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    count = [0] * len(known)
    for i, (_, a) in enumerate(known):
        for j, (_, b) in enumerate(known[:i]):
            if len(a) == len(b) and a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)) >= least:
                count[i] += 1
                count[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    low = {}
    for i, (v, _) in enumerate(known):
        low[find(i)] = min(v, low.get(find(i), v))
    out = [(v, count[i], low[find(i)]) for i, (v, _) in enumerate(known)]
    rest = [v for v, x, _ in rows if not (v is not None and x is not None and None not in x and np.isfinite(x).all() and np.any(np.array(x) != 0))]
    assert links or not rows
    return sorted(out + [(v, 0, v) for v in rest], key=repr)


@pytest.mark.parametrize(("block", "sample", "kind"), [(2048, 1024, "float"), (16, 64, "float"), (7, 10, "double")])
def test_near_vectors(spark, block, sample, kind):
    rows = families()
    got = sorted((tuple(r) for r in vector_dedup.link(vectors_frame(spark, rows, kind), block=block, sample=sample).collect()), key=repr)
    assert got == brute_links(rows)
    assert max(n for _, n, _ in got) >= 89


def test_threshold_itself(spark):
    """A cosine of 0.9 links, one of a little less doesn't."""
    rows = [(1, [1.0, 0.0, 0.0, 0.0], 0), (2, [9.0, 1.0, 3.0, 3.0], 0), (3, [-2.0, 0.0, 0.0, 0.0], 0), (4, [-18.0, 2.0, 6.0, 6.000001], 0)]
    assert sorted(tuple(r) for r in vector_dedup.link(vectors_frame(spark, rows, "double")).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)]


def odd_vectors():
    nan, inf = float("nan"), float("inf")
    return [(1, None, 0), (2, [], 0), (3, [0.0] * 16, 0), (4, [nan] + [1.0] * 15, 0), (5, [1.0] * 15 + [inf], 1), (6, [None] + [1.0] * 15, 1), (7, [1.0] * 16, 1), (8, [1.0] * 16, None), (8, [1.0] * 16, None), (8, [-1.0] * 16, 2), (9, [1.0] * 8, 2), (None, [1.0] * 16, 3), (10, [1e30] * 16, 3), (11, [1e-30] * 16, 3)]


def test_odd_vectors(spark):
    rows = odd_vectors()
    assert sorted((tuple(r) for r in vector_dedup.link(vectors_frame(spark, rows)).collect()), key=repr) == brute_links(rows)
    for some in ([], rows[:3]):
        assert sorted((tuple(r) for r in vector_dedup.link(vectors_frame(spark, some)).collect()), key=repr) == brute_links(some)


def test_cover_tree():
    u = vector_dedup.unit(np.random.default_rng(2).normal(size=(200, 3)))
    levels = vector_dedup.cover_tree(u)
    for k, (nodes, parents, radii) in enumerate(levels[:-1]):
        gaps = np.linalg.norm(u[nodes][:, None] - u[nodes][None], axis=2)
        assert (gaps[~np.eye(len(nodes), dtype=bool)] > vector_dedup.RADII[k] - 1e-9).all()
        at = vector_dedup.members(levels, k)
        assert (np.linalg.norm(u - u[nodes[at]], axis=1) <= radii[at] + 1e-6).all()
        if k:
            above = levels[k - 1][0]
            assert set(above) <= set(nodes)
            assert (np.linalg.norm(u[nodes] - u[above[parents]], axis=1) <= vector_dedup.RADII[k - 1] + 1e-9).all()


def brute_codes(rows, parts, entries, rounds):
    """Every entry tried, in Python's integers."""
    kept = [(v, [math.floor(256 * c) for c in x], lab) for v, x, lab in rows if x is not None and None not in x and np.isfinite(x).all()]
    first = {}
    for v, x, _ in sorted(((v, x, 0) for v, x, _ in kept if v is not None)):
        first.setdefault(v, x)
    ids = sorted(first)[:entries]
    dims = len(first[ids[0]])
    kept = [k for k in kept if len(k[1]) == dims]
    w = dims // parts
    cut = lambda x, p: x[p * w : (p + 1) * w]
    books = [[cut(first[i], p) for i in ids] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, x, _ in kept:
                held.setdefault(near(cut(x, p), books[p])[1], []).append(cut(x, p))
            for k, xs in held.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [(v, [near(cut(x, p), books[p]) for p in range(parts)], lab) for v, x, lab in kept]
    return sorted(((v, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n)) for v, n, _ in found), key=repr), books


@pytest.mark.parametrize(("parts", "entries"), [(16, 64), (4, 9)])
def test_vector_codes(spark, parts, entries):
    rows = families(4, 100)
    df = vector_codes.usable(vectors_frame(spark, rows))
    books = vector_codes.fit(df, parts, entries)
    got = sorted(((r["vec_id"], r["code"], r["error"]) for r in vector_codes.encode(df, books).collect()), key=repr)
    want, want_books = brute_codes(rows, parts, entries, 2)
    assert books.tolist() == want_books and got == want


def test_bounds_hold():
    """Whatever entries and parts: bounds keep the nearest entry, and ties go to the lower index."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        book = rng.integers(-5, 5, (rng.integers(1, 40), 3))
        parts = rng.integers(-9, 9, (30, 3))
        d = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        entry, far = vector_codes.Cells(book).nearest(parts)
        assert (entry == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()


def test_odd_codes(spark, tmp_path):
    rows = [r for r in odd_vectors() if r[0] not in (2, 9, 10, 11)]
    vectors_frame(spark, rows).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    got = vector_codes.query(spark, f"{tmp_path}/a").collect()
    want, books = brute_codes(rows, 16, 64, 2)
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in got), key=repr) == want
    flat = ",".join(str(c) for book in books for e in book for c in e)
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(flat.encode()).hexdigest()}
    for name, some in (("b", []), ("c", [(1, [1.0] * 3, 0), (2, [1.0] * 16, 0)]), ("d", [(1, [], 0)])):
        vectors_frame(spark, some).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert vector_codes.query(spark, f"{tmp_path}/{name}").collect() == []
    huge = vector_codes.usable(vectors_frame(spark, odd_vectors()))
    assert all(r["error"] >= 0 for r in vector_codes.encode(huge, vector_codes.fit(huge)).collect())


#: Columns that the queries' contracts name.
CONTRACTS = {
    11: {"conv_id": "bigint", **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "bigint"), "audit": "string", "repaired_sha256": "string"},
    12: {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
    13: {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
}


@pytest.mark.parametrize("number", sorted(CONTRACTS))
def test_registered_query(spark, sf_dir, duck, number):
    """The query's columns over the whole smallest table, and its rows against its SQL."""
    from leafworks.llm import registry

    name = next(n for n in registry.QUERIES if n.startswith(f"op{number}_"))
    df = registry.QUERIES[name](spark, sf_dir)
    assert dict(df.dtypes) == CONTRACTS[number]
    got = sorted(map(tuple, df.collect()))
    if number == 11:
        assert [r[0] for r in got] == [r[0] for r in duck.sql("select distinct conv_id from conversations order by 1").fetchall()]
        return
    want = duck.sql(f"select {', '.join(df.columns)} from ({registry.ORACLES[name]})").fetchall()
    assert got == sorted(want)


def test_blocks_move_once_a_square(spark, monkeypatch):
    """Squares of any size give the same links."""
    rng = np.random.default_rng(31)
    base = rng.normal(size=(60, 8))
    rows = [(i, [float(c) for c in base[i % 60] + 0.2 * rng.normal(size=8)], 0) for i in range(240)]
    want, frame_ = brute_links(rows), vectors_frame(spark, rows, "double")
    seen = []
    opened = vector_dedup.opened
    monkeypatch.setattr(vector_dedup, "opened", lambda pairs, blocks, least, side=1: (seen.append((pairs.count(), side)), opened(pairs, blocks, least, side))[1])
    for squares in (100, 4, 1):
        monkeypatch.setattr(vector_dedup, "SQUARES", squares)
        got = sorted((tuple(r) for r in vector_dedup.link(frame_, block=12, sample=64).collect()), key=repr)
        assert got == want
    assert len({n for n, _ in seen}) == 1 and 1 == seen[0][1] < seen[1][1] < seen[2][1]
