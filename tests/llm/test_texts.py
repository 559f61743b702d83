"""One-pass operators: BPE, quality, personal data, toxicity, licenses; and chat windows and mixing."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafworks.llm import bpe, chat, licenses, mixing, pii, quality, toxicity

from .conftest import edge_docs, frame, make_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_bpe(spark, edges, empty, ranks):
    enc = bpe.encoding(*ranks)
    out = bpe.decode(bpe.encode(edges, *ranks), *ranks)
    assert "source" in out.columns and "key" in out.columns
    want = collections.Counter((i, tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for i, t in edge_docs())
    got = collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in out.collect())
    assert got == want
    assert bpe.encode(empty, *ranks).count() == 0
    few = bpe.encode(edges.where("doc_id in (4, 10)"), *ranks).select("doc_id", bpe.unpack(F.col("ids")).alias("x"), bpe.n_ids(F.col("ids")).alias("n")).collect()
    assert all(r.n == len(r.x) and r.x == enc.encode_ordinary(dict(edge_docs())[r.doc_id]) for r in few)


def test_safe_pieces(ranks):
    enc, rng = bpe.encoding(*ranks), random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["a", "Z", "9", " ", "  ", "\n", "'s", "'ll ", "é", "!", "\t", " word", "日", "don't"]) for _ in range(400))
        parts = list(bpe.pieces(text, 37))
        assert "".join(parts) == text and len(parts) > 1
        assert [x for p in parts for x in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_endless_texts(spark, ranks):
    """White space, other scripts and endless words of a million characters: round trips, and ids equal to those of the matches."""
    enc, rng = bpe.encoding(*ranks), random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("aA9 \n\té日!—ñ😀\u3000") for _ in range(rng.randint(1, 300)))
        assert bpe.encode_long(enc, text).tolist() == enc.encode_ordinary(text)
        assert [x for m in bpe.splitter(ranks[1]).finditer(text) for x in bpe.merged(m[0].encode(), enc._mergeable_ranks)] == enc.encode_ordinary(text)
    long = [" " * 10**6, "\n" * 10**6, "日本語" * 300_000, "a" * 10**6, "x y" + "\t" * 10**6 + "end"]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    for r in bpe.decode(bpe.encode(df, *ranks), *ranks).collect():
        assert bytes(r.decoded) == long[r.doc_id].encode() and len(r.ids) % 4 == 0
    assert np.frombuffer(bpe.encode_text(enc, long[0]).tobytes(), "<u4").tolist() == [enc.encode_ordinary(" ")[0]] * 10**6 or enc.encode_ordinary(" " * 5000) == bpe.encode_text(enc, " " * 5000).tolist()
    with pytest.raises(ValueError, match="ids"):
        bpe.encode(df.withColumn("ids", F.lit(1)), *ranks)


def base(text):
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    held = {k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(held) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(held), failed


def brute_scores(rows, good_ids, n=quality.GRAM, bits=quality.BITS):
    def buckets(t):
        b, out = t.encode(), []
        for i in range(len(b) - n + 1):
            x = 0
            for c in b[i : i + n]:
                x = (x * 257 + c) % 2**32
            x = (x ^ x >> 15) * 0x2C1B3C6D % 2**32
            x = (x ^ x >> 12) * 0x297A2D39 % 2**32
            out.append(x >> 32 - bits)
        return out

    raw, good = np.ones(1 << bits), np.zeros(1 << bits)
    for i, t in rows:
        for b in buckets(t):
            raw[b] += 1
            good[b] += i in good_ids
    raw /= raw.sum()
    good = (good + quality.PRIOR * raw) / (good.sum() + quality.PRIOR)
    w = np.log(good) - np.log(raw)
    return [float(np.mean(w[buckets(t)])) if len(t.encode()) >= n else 0.0 for _, t in rows]


def test_quality(spark, labels):
    rows = make_docs(5, 40) + [(50, "a b " * 40), (51, ("x y z w v u t s r\n" * 3)), (52, "# * | " * 30)]
    df = frame(spark, rows)
    weights = quality.fit(df, labels)
    got = {r.doc_id: r for r in quality.assess(df, weights).collect()}
    scores = brute_scores(rows, {i for i in range(60) if i % 5} | {3})
    for (i, t), score in zip(rows, scores, strict=True):
        r = got[i]
        assert (r.quality_n_words, r.quality_word_chars, r.quality_n_symbols, r.quality_n_dup_lines, r.quality_n_repeat_words, r.quality_base_failed) == base(t)
        assert r.quality_score == pytest.approx(score, abs=1e-4) and r.quality_kept == (not r.quality_base_failed and r.quality_score >= quality.THRESHOLD)
        assert r.kept == "x" and r.text == t


def test_quality_edges(spark, edges, empty, labels, no_labels):
    weights = quality.fit(edges, no_labels)
    assert np.allclose(weights, 0)
    got = quality.assess(edges, weights).collect()
    assert len(got) == len(edge_docs()) and {r.quality_kept for r in got if not r.text} == {False}
    kept = quality.keep_good(edges, no_labels)
    assert kept.columns == edges.columns and {r.doc_id for r in kept.collect()} == {5, 6} - {i for i, t in edge_docs() if t and base(t)[5]}
    assert quality.keep_good(empty, labels).count() == 0


PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_base(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and max(int(x) for x in m[0].split(".")) > 255 or k == 2 and not (13 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_base_patterns():
    rng = random.Random(4)
    parts = ["a@b.c", "@", ".", "x", "1", "22", "+1", " (", ") ", "-", " ", "4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.1", "300.1.1.1", "+1 (988) 555-2485", "é", "a.b+c@d-e.f.g", "@@", "1.2.3.4.5.6.7.8", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text) == brute_base(text), text


def test_base_is_linear():
    import time

    began = time.time()
    for text in ("a" * 400_000, "1" * 400_000, "+" * 200_000, "1." * 200_000, "@" * 200_000, "a@" * 200_000, "+1 " * 200_000):
        pii.find(text, None)
    assert time.time() - began < 20


def contacts(seed, n):
    """Texts that name a person's e-mail and phone, and hold other numbers."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        name, num = "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(5, 9))), "".join(rng.choice("0123456789") for _ in range(10))
        year, room = rng.randint(1800, 2024), rng.randint(1, 400)
        out.append((f"in {year} write to {name}@mail{room}.example.com or call +1 ({num[:3]}) {num[3:6]}-{num[6:]} about room {room} and x{room} of {rng.randint(10**9, 10**10)}", name, num))
    return out


def test_skip_chain():
    """Bare repetitions of what is marked somewhere are marked, however many; without the ties none is, and other words stay clean."""
    field = pii.train([t for t, *_ in contacts(6, 300)])
    assert field.skip.diagonal()[[1, 4]].min() > 1 and (field.skip < 0).any()
    flat = pii.Field(field.unary, field.chain * 0, field.skip * 0)
    hit = bare = wrong = other = 0
    for text, name, num in contacts(7, 100):
        for echo, kind in ((name, "email"), (num, "phone"), (f"{num[:3]} {num[3:6]} {num[6:]}", "phone")):
            for times in (1, 40):
                whole = text + f". Later {echo} came" * times
                spans = pii.find(whole, field)[1]
                base_ = pii.base_spans(whole)
                assert set(base_) <= set(spans)
                added = [(pii.KINDS[k], whole[s:e]) for k, s, e in spans if (k, s, e) not in base_]
                hit += added.count((kind, echo)) == times
                wrong += len(added) - added.count((kind, echo))
                other += 1
                bare += any(whole[s:e] == echo for k, s, e in pii.find(whole, flat)[1] if (k, s, e) not in base_)
    assert hit / other > 0.95 and wrong / other < 0.02 and bare / other < 0.2
    assert pii.find("no digits here", field) == ([], []) and pii.train(["nothing"]) is None
    clean = "in 1987 the 3 of 42 and 7th 100%"
    assert pii.find(clean, field)[1] == []


def test_personal_data_long_words():
    """A word counts whole, not by its ends."""
    x = pii.features("1" * 300 + "a" * 300 + "1" * 300, [(0, 900)])
    assert x[0, 8] == 1 and x[0, 9] == 1


def test_personal_data_rows(spark, edges, empty):
    got = pii.scan(edges, None).collect()
    assert len(got) == len(edge_docs()) and all(r.base == [] for r in got)
    assert pii.scan(empty, None).count() == 0 and pii.sample_texts(empty) == []


def toxic_docs():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(40)]
        # Neither word is toxic alone; the pair is.
        if i % 3 == 0:
            text += ["grumble", "zorks"]
        elif i % 3 == 1:
            text += [rng.choice(["grumble", "zorks"])]
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 3 == 0)))
    return rows, labels


def test_toxicity_pairs(spark):
    rows, labels = toxic_docs()
    df, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(df, toxicity.fit(df, lab)).join(lab, "doc_id").withColumn("held", toxicity.fold(F.col("doc_id")) == 0).where("held").collect()
    assert len(got) > 100 and np.mean([(r.score >= 0.5) == bool(r.toxic) for r in got]) > 0.95


def test_toxicity_equal_odds(spark):
    """Two words, each as often in clean as in toxic texts: only both or neither of them is toxic."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(3000):
        text = [rng.choice(words) for _ in range(40)] + [["grumble", "zorks"], [], ["grumble"], ["zorks"]][i % 4]
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 4 < 2)))
    df, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(df, toxicity.fit(df, lab)).join(lab, "doc_id").where(toxicity.fold(F.col("doc_id")) == 0).collect()
    assert len(got) > 400 and np.mean([(r.score >= 0.5) == bool(r.toxic) for r in got]) > 0.95


def test_toxicity_edges(spark, edges, empty, labels, no_labels):
    scores = [r.score for r in toxicity.score(edges, toxicity.fit(edges, labels)).collect()]
    assert len(scores) == len(edge_docs()) and all(0 <= s <= 1 for s in scores)
    assert max(r.score for r in toxicity.score(edges, toxicity.fit(edges, no_labels)).collect()) < 1e-6
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_toxicity_of_the_tables(spark):
    """Held-out rows of the given labels: most toxic documents are found, hardly any other."""
    sf_dir = os.path.join(os.path.dirname(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")), "sf0.1")
    if not os.path.exists(f"{sf_dir}/labels.parquet"):
        pytest.skip("no larger tables here")
    got = toxicity.query(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out and toxic is not null").collect()
    hits, wrong = [r.predicted for r in got if r.toxic], [r.predicted for r in got if not r.toxic]
    assert len(hits) > 50 and np.mean(hits) >= 0.8 and np.mean(wrong) < 0.005


def test_licenses(spark, edges, empty):
    mit = licenses.TEMPLATES["MIT/grant"]
    words = mit.split(" ")
    rows = [(1, "intro words " * 30 + mit + " tail" * 50), (2, "x " * 17 + " ".join(words[:40] + ["NEW"] + words[40:]) + " y"), (3, "nothing of the kind " * 40), (4, "a\nReleased under the MIT License.\nb"), (5, " ".join(words[:20])), (6, None), (None, mit)]
    got = {(r.doc_id, r.template): r for r in licenses.scan(frame(spark, rows)).collect()}
    assert set(got) == {(1, "MIT/grant"), (2, "MIT/grant"), (4, "MIT/line"), (None, "MIT/grant")}
    assert got[1, "MIT/grant"].containment == 1.0 and got[1, "MIT/grant"].first_word == 60 and 0.9 < got[2, "MIT/grant"].containment < 1
    assert licenses.scan(edges).count() == 0 and licenses.scan(empty).count() == 0 and licenses.scan(edges, {}).count() == 0


def contained(text):
    """Template: share of its 5-word shingles in the whole text, by plain sets."""
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    held = grams(words(text))
    return {n: len(held & grams(words(t))) / len(grams(words(t))) for n, t in licenses.TEMPLATES.items()}


def test_licenses_by_brute_force(spark):
    """Every template, words changed, inserted or dropped, alone or beside others: the matches that plain containment gives."""
    rng, names = random.Random(9), sorted(licenses.TEMPLATES)
    rows = []
    for i in range(240):
        w = licenses.TEMPLATES[names[i % len(names)]].split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice([["new"], [], ["two", "more"]])
        rows.append((i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(0, 80))) + " " + " ".join(w) + " " + " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(0, 80)))))
    want = {}
    for i, t in rows:
        shares = {n: s for n, s in contained(t).items() if s >= 0.8 - 1e-9}
        top = max(shares.values(), default=0)
        want[i] = {n for n, s in shares.items() if s == top}
    got = collections.defaultdict(set)
    for r in licenses.scan(frame(spark, rows)).collect():
        got[r.doc_id].add(r.template)
        assert r.containment == pytest.approx(contained(rows[r.doc_id][1])[r.template])
    assert sum(map(bool, want.values())) > 100 and all(got[i] == want[i] for i in want)


def test_interrupted_licenses(spark):
    """A notice in two or three parts with passages between them is retrieved and counted as one."""
    rng, names = random.Random(10), [n for n, t in licenses.TEMPLATES.items() if len(t.split(" ")) >= 40]
    rows = []
    for i in range(60):
        w = licenses.TEMPLATES[names[i % len(names)]].split(" ")
        n = len(w)
        for cut in ([1 / 2], [1 / 3, 2 / 3])[i % 2][::-1]:
            at = int(cut * n)
            w[at:at] = [f"x{rng.randrange(900)}" for _ in range(120)]
        rows.append((i, " ".join(w)))
    got = {(r.doc_id, r.template) for r in licenses.scan(frame(spark, rows)).collect()}
    # Cuts may take away what sets a family's notices apart: the fullest counts.
    wanted = [(i, max((s, n) for n, s in contained(t).items())) for i, t in rows]
    wanted = [(i, n) for i, (s, n) in wanted if s >= 0.8]
    assert len(wanted) > 40 and np.mean([x in got for x in wanted]) >= 0.95


def test_quality_verdict(spark, sf_dir):
    """On labels that the trusted sample wasn't given: good documents mostly stay, and bad ones score lower."""
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    weights = quality.fit(docs, labels.where("pmod(xxhash64(doc_id), 2) = 0"))
    got = quality.assess(docs.select("doc_id", "text"), weights).join(labels.where("pmod(xxhash64(doc_id), 2) = 1"), "doc_id").select("quality", "quality_kept", "quality_score", "quality_base_failed").collect()
    good, bad = ([r for r in got if r.quality == q] for q in (1, 0))
    assert len(good) > 30 and len(bad) > 10
    assert np.mean([r.quality_kept for r in good if not r.quality_base_failed]) >= 0.85
    assert np.mean([r.quality_kept for r in bad]) <= 0.3


def test_toxicity_is_the_pair_sum():
    """Scores are those of the explicit double sum, and an additive model can't learn what the machine does."""
    rng = np.random.default_rng(4)
    sets = [np.unique([*rng.integers(3, 40, 10), *([1, 2], [], [1], [2])[i % 4]]).astype(np.int64) for i in range(800)]
    y = np.array([int(i % 4 < 2) for i in range(800)])
    m = toxicity.train(y, sets, bits=6, epochs=600)
    p = []
    for s in sets:
        at = [int(np.flatnonzero(m.buckets == b)[0]) for b in s if b in m.buckets]
        z = m.w0 + sum(m.w[i] for i in at) + sum(float(m.v[i] @ m.v[j]) for k, i in enumerate(at) for j in at[k + 1 :])
        p.append(1 / (1 + np.exp(-z)))
    doc, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.searchsorted(m.buckets, np.concatenate(sets))
    assert np.allclose(toxicity._sigmoid(toxicity._logits(m.w0, m.w, m.v, doc, at, len(sets))), p)
    # An additive model, by the same steps: a weight for each term alone.
    x, w = np.column_stack([np.ones(len(sets)), *[[b in s for s in sets] for b in m.buckets]]).astype(float), np.zeros(len(m.buckets) + 1)
    for _ in range(2000):
        w -= 0.5 * (x.T @ (toxicity._sigmoid(x @ w) - y) / len(y))
    plain = toxicity._sigmoid(x @ w)
    right = lambda q: np.mean((np.array(q) >= 0.5) == y)
    assert right(p) > 0.9 and right(p) > right(plain) + 0.15


def test_repeated_ids_in_samples(spark, labels):
    """A repeated id gives a sample one row, however often it stands there."""
    df = frame(spark, [(1, f"call +1988555{i:04} now") for i in range(50)] + [(2, "mail a.bcde@x.org")])
    assert len(pii.sample_texts(df)) == 2
    assert toxicity.score(df, toxicity.fit(df, labels)).count() == 51


def test_chat(spark):
    rng = random.Random(8)
    rows = []
    for c in [1, 2, 3, 4, None]:
        for t in range(rng.randint(1, 25)):
            role = "system" if t == 0 and c != 2 else rng.choice(["user", "assistant", "we:ird\\#<"])
            rows.append((c, t if rng.random() < 0.95 else None, role if rng.random() < 0.95 else None, rng.choice(["### x: y </turn>\n", "\\", "\\#", "", "plain é 日 " * rng.randint(1, 60), "a\n### user: b </turn>\n", None])))
    rows += [(5, 0, "assistant", "same"), (5, 0, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    w = chat.format_windows(df, budget=40, history=2).cache()
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append(((t is not None, t or 0), r or "", x or ""))
    said, learned = collections.defaultdict(list), collections.defaultdict(list)
    for r in chat.read_windows(w).orderBy("window", "pos").collect():
        if not r.repeated:
            said[r.conv_id].append((r.role, r.text))
    for r in chat.read_learned(w).orderBy("window", "start").collect():
        learned[r.conv_id].append(r.text)
    for c, turns in convs.items():
        turns = [(r, x) for _, r, x in sorted(turns)]
        assert said[c] == turns
        assert learned[c] == [x for r, x in turns if r == "assistant"]
    first = {c: min(r.window for r in got if r.conv_id == c) for got in [w.collect()] for c in convs}
    later = [r for r in chat.read_windows(w).where("pos = 0 and conv_id in (1, 3, 4)").collect() if r.window > first[r.conv_id]]
    assert later and all(r.repeated for r in later if (r.role != "user" and r.role != "assistant"))
    assert w.agg(F.max("n_repeated")).first()[0] <= 3
    assert chat.format_windows(spark.createDataFrame([], df.schema)).count() == 0


def test_chat_budget(spark, monkeypatch):
    """No window is over the budget with all that it repeats, but for lone long turns; blocks of prefix sums change nothing."""
    rng = random.Random(12)
    rows = []
    for c in range(6):
        rows += [(c, t, "system" if t == 0 and c % 2 else rng.choice(["user", "assistant"]), "word " * rng.choice([1, 3, 8, 20, 40, 200])) for t in range(rng.randint(30, 60))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, chat.format_windows(df, budget=120).collect()))
    turns = collections.Counter((r.conv_id, r.window) for r in chat.read_windows(chat.format_windows(df, budget=120)).where("not repeated").collect())
    assert any(r[6] for r in got)
    for conv, window, text, repeated, spans, tokens, over in got:
        assert over == (tokens > 120) and tokens >= len(text) / 4
        if over:
            assert turns[conv, window] == 1
    assert any(r[3] for r in got) and max(turns.values()) > 2
    monkeypatch.setattr(chat, "BLOCK", 7)
    assert sorted(map(tuple, chat.format_windows(df, budget=120).collect())) == got


def test_chat_query_without_rows(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.query(spark, str(tmp_path)).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in got] == [(-7, 2, 26)]


def targets(sizes, most=3.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float(i % 3 + 1) for i, s in enumerate(order)}
    total, out, open_ = sum(sizes.values()), {}, set(sizes)
    while open_:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s] + 1e-9}
        for s in over or open_:
            out[s] = most * sizes[s] if over else share[s]
        open_ -= over or set(open_)
    return out


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 40), f"s{rng.choice('aabbbbbbcde')}" if i % 11 else None) for i in range(700)] + [(701, "w " * 3, "sz"), (702, None, "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, group=8).collect()
    sizes = collections.Counter()
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets(sizes)
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.taken == r.size * r.copies and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40 + 1e-6, (s, taken[s], want[s])
    again = {r.doc_id: r.taken for r in mixing.mix_sources(df.repartition(5), group=8).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_pivotal_odds(spark):
    """Over many seeds, each document is taken as often as its probability says."""
    rows = [("s", str(i), i * 977, float(1 + i % 4), [0.2, 0.5, 0.8][i % 3]) for i in range(24)]
    df = spark.createDataFrame(rows, "source string, id string, draw long, w double, p double").cache()
    hits = collections.Counter()
    for seed in range(25):
        for r in mixing.pivotal(df, seed, group=6).collect():
            hits[int(r.id) % 3] += r.take
    for k, p in enumerate([0.2, 0.5, 0.8]):
        assert abs(hits[k] / (25 * 8) - p) < 0.12


def test_mixing_edges(spark, edges, empty):
    assert mixing.mix_sources(empty).count() == 0
    got = mixing.mix_sources(edges).collect()
    assert len(got) == len(edge_docs()) and all(r.taken == 0 for r in got if not r.size)
    copies = mixing.with_copies(edges)
    assert copies.columns == edges.columns and all(r.key == "x" for r in copies.collect())


def test_copies_of_ids_in_two_sources(spark):
    """Every row comes as often as its own source takes it."""
    rng = random.Random(3)
    rows = [(i % 150, "w " * rng.randint(1, 9), f"s{i % 2}", f"x{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    want = collections.Counter()
    for r in mixing.mix_sources(df).collect():
        want[r.doc_id, r.source] += r.copies
    got = collections.Counter((r.doc_id, r.source) for r in mixing.with_copies(df).collect())
    assert got == +want and all(r.copies.startswith("x") for r in mixing.with_copies(df).collect())


#: Columns that the queries' contracts name.
CONTRACTS = {
    1: {"doc_id": "bigint", "n_removed": "bigint", "text_sha256": "string"},
    2: {"doc_id": "bigint", "template": "string", "containment": "double"},
    3: {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    4: {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    5: {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    6: {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    7: {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    8: {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    9: {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    10: {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


@pytest.mark.parametrize("number", sorted(CONTRACTS))
def test_registered_query(spark, sf_dir, ranks, number):
    """The query's columns and rows, and what plain code can say of them, over the whole smallest table."""
    import zlib

    from leafworks.llm import registry

    name = next(n for n in registry.QUERIES if n.startswith(f"op{number}_"))
    df = registry.QUERIES[name](spark, sf_dir)
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in CONTRACTS[number]} == CONTRACTS[number]
    rows = df.collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    if number not in (2, 7):
        assert sorted(r.doc_id for r in rows) == sorted(docs)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    if number == 2:
        assert rows and all(contained(docs[r.doc_id])[r.template] >= 0.8 for r in rows)
        assert {i for i, t in docs.items() if max(contained(t).values()) >= 0.8} == {r.doc_id for r in rows}
    enc = bpe.encoding(*ranks)
    for r in rows if number not in (2, 7) else ():
        text = docs[r.doc_id]
        if number == 1:
            assert r.n_lines == text.count("\n") + 1 and 0 <= r.n_removed <= r.n_lines
        elif number == 4:
            assert r.n_chars == len(text)
        elif number == 5:
            ids = np.array(enc.encode_ordinary(text), "<u4")
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(ids.tobytes()), sha(text.encode()))
        elif number == 6:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text)
        elif number == 8:
            found = brute_base(text)
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in found) for x in range(4)]
            assert r.base_sha256 == sha(pii.digest(found).encode()) and set(pii.digest(found).split(",")) - {""} <= set(r.spans.split(","))
        elif number == 9:
            assert r.size == len(WORD.findall(text)) and r.taken <= 3 * r.size
        elif number == 10:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
            from leafworks.llm.common import written

            docs = written(docs)
            last = docs
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = sorted((r.doc_id, hashlib.sha256(np.array(enc.encode_ordinary(r.text or ""), "<u4").tobytes()).hexdigest()) for r in last.collect())
    assert want == sorted((r.doc_id, r.ids_sha256) for r in docs.collect()) and want
