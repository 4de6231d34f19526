"""Operators against plain programs over the smallest tables, and by round trips."""

import hashlib
import json
import math
import random
import re
import struct
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))
from lodestone.llm import bpe, html_text, mixing, near_dup, neighbours, pii, quality_model, quality_rules, registry, warc  # noqa: E402
from oracle import connect, rows  # noqa: E402

SPACE = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    made, want = registry.queries()[name](spark, sf).toPandas(), connect(sf).execute(registry.oracle_sql()[name]).df()
    assert rows(made[sorted(want.columns)]) == rows(want)


def _luhn(digits):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def _base_spans(text):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for rank, (kind, pattern) in enumerate(plain.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(d) <= 19 and _luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]():
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii_spans(spark, sf, texts):
    made = {r["doc_id"]: r for r in pii.op1_pii(spark, sf).collect()}
    assert all(made[i]["base_sha256"] == hashlib.sha256(_base_spans(t).encode()).hexdigest() for i, t in texts.items())


def _disclosing_spans(texts):
    """All spans of every text by a plain program: base ones, and terms by counts over whole documents."""
    import regex

    base, terms = {}, {}
    for i, t in texts.items():
        base[i] = [(int(a), KIND[k], int(b)) for k, a, b in (x.split(":") for x in _base_spans(t).split(",") if x)]
        terms[i] = [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(pii.TERM, t)]
    named = {i: {(r, texts[i][a:b].lower() if r == 0 else re.sub("[^0-9.]", "", texts[i][a:b])) for a, r, b in base[i]} for i in texts}
    n_t, n_e, n_et = Counter(), Counter(), Counter()
    for i in texts:
        held = {t for *_, t in terms[i]}
        n_t.update(held)
        n_e.update(named[i])
        n_et.update((e, t) for e in named[i] for t in held)
    share = {}
    for (e, t), both in n_et.items():
        p, a = n_e[e] / len(texts), pii.SUPPORT**2 / both**1.5
        share[e, t] = 1 - math.log2((both + a * p) / (n_t[t] + a)) / math.log2(p) if p < 1 else 0
    for i in texts:
        flagged = {t for *_, t in terms[i] if any(share[e, t] >= pii.GENERALISE for e in named[i])}
        extra = [(a, 4, b) for a, b, t in terms[i] if t in flagged and not any(c < b and a < d for c, _, d in base[i])]
        yield i, ",".join(f"{pii.KINDS[r]}:{a}:{b}" for a, r, b in sorted(base[i] + extra))


KIND = {k: n for n, k in enumerate(pii.KINDS)}


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_pii_all_spans(spark, scale):
    at = f"/root/testdata/{scale}"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    made = {r["doc_id"]: (r["spans"], r["n_term"]) for r in pii.op1_pii(spark, at).collect()}
    want = dict(_disclosing_spans(texts))
    assert {i: s for i, (s, _) in made.items()} == want
    assert all(n == s.count("term:") for s, n in made.values())


def test_pii_patterns_on_odd_texts(spark):
    rnd = random.Random(3)
    odd = ["".join(rnd.choice(["a", "@", ".", "b-", "_", "1", "12", "255", "4012 8888 8888 1881", "+1", " ", "(", "é🙂", "x@y.z", "1.2.3.4", "-"]) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    odd += ["1" * 50_000, "a" * 50_000, "1.2." * 5_000, "a@b" + ".c" * 5_000, "+1" + "(" * 20_000, "4 " * 3_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    made = {r["doc_id"]: ",".join(f"{pii.KINDS[s['rank']]}:{s['start']}:{s['end']}" for s in r["spans"]) for r in pii.find(spark, df).collect()}
    assert [i for i, t in enumerate(odd) if made[i] != _base_spans(t)] == []


def test_mixing(spark, sf, texts):
    made = mixing.op7_mixing(spark, sf).collect()
    assert {r["doc_id"]: r["size"] for r in made} == {i: len(re.findall(SPACE, t)) for i, t in texts.items()}
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in made)
    taken, most = defaultdict(int), defaultdict(int)
    for r in made:
        k = r["source_size"], r["target"]
        taken[k] += r["taken"]
        most[k] = max(most[k], r["size"])
    assert all(abs(t - k[1]) <= most[k] / 2 + 1 for k, t in taken.items())
    again = mixing.op7_mixing(spark, sf).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in made) == sorted((r["doc_id"], r["taken"]) for r in again)


def _components(texts, width=4):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        k = min(width, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [i for i in texts if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


@pytest.mark.parametrize("group", [2000, 3])
def test_near_duplicates(spark, sf, texts, group):
    made = near_dup.classes(spark, spark.read.parquet(f"{sf}/documents.parquet"), 4, group)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in made.collect()} == _components(texts)


def test_near_duplicate_families(spark):
    """Chains of edits, families of copies over many chunks, and a stray that only joins through one member."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    docs = {}
    for i in range(60):
        w = base[:]
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(120)] = word()
        docs[i] = " ".join(w)
    chain = [word() for _ in range(100)]
    for i in range(60, 75):
        chain[(i - 60) * 6] = word()
        docs[i] = " ".join(chain)
    for i in range(75, 90):
        docs[i] = " ".join(word() for _ in range(50))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    made = {r["doc_id"]: r["component_id"] for r in near_dup.classes(spark, df, 4, 7).collect()}
    assert made == {i: c for i, (_, c) in _components(docs).items()}


def _linked_components(texts, width=4):
    """As _components(), by one matrix of documents and shingles: for families whose pairs are too many to loop over."""
    sets = {i: {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} for i, t in texts.items() for w in [t.split()]}
    place = {s: k for k, s in enumerate(sorted(set().union(*sets.values())))}
    ids, m = list(sets), np.zeros((len(sets), len(place)), np.float32)
    for n, i in enumerate(ids):
        m[n, [place[s] for s in sets[i]]] = 1
    size, common = m.sum(axis=1), m @ m.T
    links = 100 * common >= 80 * (size[:, None] + size[None, :] - common)
    made = {}
    for start in range(len(ids)):
        todo = [start] if ids[start] not in made else []
        while todo:
            at = todo.pop()
            made.setdefault(ids[at], ids[start])
            todo += [k for k in np.flatnonzero(links[at]).tolist() if ids[k] not in made and not made.update({ids[k]: ids[start]})]
    return made


@pytest.mark.parametrize(("group", "parts"), [(2000, 4), (150, 4), (150, 11)])
def test_near_duplicate_crowds(spark, group, parts):
    """A family of 1,000 near copies that all share long prefixes, strays whose only links are at 0.8 to members of it,
    and another family of one template without links. The components are the plain ones, however the rows are dealt."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    base, docs = [word() for _ in range(150)], {}
    for i in range(1000):
        w = base[:]
        for at in rnd.sample(range(20, 150), rnd.randint(0, 2)):
            w[at] = f"{base[at]}x{rnd.randint(0, 3)}"
        docs[i] = " ".join(w)
    for i in range(1000, 1040):  # the edits of a member, and so many more words that the similarity is just enough or not
        docs[i] = docs[i - 1000] + " " + " ".join(word() for _ in range(rnd.randint(33, 40)))
    for i in range(1040, 1240):  # half of each text is the template
        docs[i] = " ".join(base[:60]) + " " + " ".join(word() for _ in range(60))
    shuffled = list(docs.items())
    rnd.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        made = {r["doc_id"]: r["component_id"] for r in near_dup.classes(spark, df, 4, group).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made == _linked_components(docs)


def test_hot_keys_meet_as_a_join_would(spark, monkeypatch):
    from lodestone.llm import common

    monkeypatch.setattr(common, "HOT", 4)
    rows = spark.createDataFrame([(k, i) for k in range(12) for i in range(40 if k == 3 else 2)] + [(None, 1)], "k int, i int")
    sizes = rows.filter("k is not null").groupBy("k").count().withColumnRenamed("count", "n").withColumn("v", F.col("k") * 2)
    made = common.join_hot(rows, sizes, ["k"], rows.count())
    assert sorted(map(tuple, made.select("k", "i", "n", "v").collect())) == sorted(map(tuple, rows.join(sizes, "k").select("k", "i", "n", "v").collect()))


def _spark_hash(*values):
    """Spark's hash of longs, strings and (as bytes) other values, one seeding the next; nulls pass the seed on."""
    import xxhash

    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v if isinstance(v, bytes) else struct.pack("<q", v), h)
    return h - 2**64 if h >= 2**63 else h


SEED = struct.pack("<i", mixing.SEED)


def _rounded(rows, chunk=64):
    """copies of every row by a plain program: rows are (doc_id, source, text)."""
    items = Counter((i, s, _spark_hash(t)) for i, s, t in rows)
    words = {(i, s, _spark_hash(t)): len(re.findall(SPACE, t or "")) for i, s, t in rows}
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(words[k] * n for k, n in items.items() if k[1] == s) for s in names}
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    target, rest, open_ = {}, 1.5 * sum(size.values()), set(names)
    while True:
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        full = [s for s in open_ if weight[s] * level >= 2 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
            rest -= target[s]
            open_.remove(s)
    target |= {s: weight[s] * level for s in open_}
    out = {}
    for s in names:
        rate = target[s] / size[s] if size[s] else 0.0
        whole, chunks = math.floor(rate), max(1, -(-sum(k[1] == s for k in items) // chunk))
        level = defaultdict(list)
        for k, n in items.items():
            if k[1] == s:
                extra = (rate - whole) * n
                sure = math.floor(extra)
                out[k] = [whole, sure if words[k] else 0]
                if extra > sure and words[k]:
                    key = _spark_hash(k[0], s, k[2])
                    level[_spark_hash(key, SEED) % chunks].append((key, k[2], words[k], (extra - sure) * words[k], k))
        while True:
            following = defaultdict(list)
            for c, group in level.items():
                a = None
                for b in sorted(group, key=lambda x: x[:2]):
                    if a is None:
                        a = b
                        continue
                    give, take = min(a[3], b[2] - b[3]), min(b[3], a[2] - a[3])
                    draw = (_spark_hash(a[0], b[0], SEED) % (1 << 40) + 0.5) / (1 << 40)
                    if draw * (give + take) < take:
                        ma, mb = (0.0 if a[3] <= b[2] - b[3] else a[3] - (b[2] - b[3])), (float(b[2]) if b[2] - b[3] <= a[3] else b[3] + a[3])
                    else:
                        ma, mb = (float(a[2]) if a[2] - a[3] <= b[3] else a[3] + b[3]), (0.0 if b[3] <= a[2] - a[3] else b[3] - (a[2] - a[3]))
                    pair, a = [(*a[:3], ma, a[4]), (*b[:3], mb, b[4])], None
                    for x in pair[::-1]:
                        if 0 < x[3] < x[2]:
                            a = x
                        else:
                            out[x[4]][1] += x[3] > 0
                if a is not None:
                    following[c // chunk].append(a)
            if chunks == 1:
                break
            chunks, level = -(-chunks // chunk), following
        for group in following.values():
            for x in group:
                out[x[4]][1] += 2 * x[3] >= x[2]
    return {k: (w, m) for k, (w, m) in out.items()}, target


def test_mixing_by_a_plain_program(spark, sf):
    """Every item's copies on a whole table, with repeated rows, a null source and a heavy row repeated many times."""
    rows = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += rows[:20] * 3 + [(7_000, None, "a b c d e"), (7_001, None, "x " * 30), (None, "s1", "y " * 11), (7_002, "many", "long text " * 50), (7_003, "many", "one two three")] + [(7_002, "many", "long text " * 50)] * 200
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want, target = _rounded(rows)
    made = {(r["doc_id"], r["source"], r["h"]): (r["whole"], r["more"]) for r in mixing.plan(spark, df).collect()}
    assert made == want
    mixed = Counter(tuple(r) for r in mixing.mix(spark, df).collect())
    left = Counter(rows)
    assert {k: n for k, n in mixed.items()} == {r: n for r in left if (n := want[r[0], r[1], _spark_hash(r[2])][0] * left[r] + want[r[0], r[1], _spark_hash(r[2])][1]) and len((r[2] or "").split())}
    taken = sum(n * len(t.split()) for (_, s, t), n in mixed.items() if s == "many")
    assert abs(taken - target["many"]) <= 50


def test_repeat_words():
    rnd = random.Random(1)
    for _ in range(300):
        w = [rnd.choice([b"a", b"b"]) for _ in range(rnd.randint(0, 40))]
        n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        want = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert quality_rules.repeat_words(w) == len(want)


def test_quality_rules(spark, sf, texts):
    made = {r["doc_id"]: r for r in quality_rules.op6_quality_rules(spark, sf).collect()}
    for i, t in texts.items():
        w, lines = re.findall(SPACE, t), [x for x in t.split("\n") if re.search(SPACE, x)]
        r = made[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 20 or 100 * r["n_repeat_words"] > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    long_enough = [i for i in good if not made[i]["base_failed"]]
    assert sum(made[i]["kept"] for i in long_enough) >= 0.99 * len(long_enough)
    orders = [quality_rules.Cascade(rules) for rules in (quality_rules.RULES, quality_rules.RULES[::-1])]
    assert all(len({c.keeps(quality_rules.Facts(t)) for c in orders}) == 1 for t in texts.values())


@pytest.fixture(scope="module")
def coder():
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    return Tokenizer.from_file(path), bpe.Encoder(json.loads(Path(path).read_text()))


def test_bpe_over_documents(spark, sf, texts, coder):
    theirs, _ = coder
    made = {r["doc_id"]: tuple(r)[1:] for r in bpe.op10_bpe(spark, sf).collect()}
    for i, t in texts.items():
        ids = theirs.encode(t, add_special_tokens=False).ids
        want = len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert made[i] == want


@settings(max_examples=600, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abeinrst'ſΣσİ\x1c\x85  é́<|endoftext|>129٣中🙂", max_size=60))
def test_bpe_on_odd_texts(coder, text):
    theirs, ours = coder
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert ours.ids(text).tolist() == ids and ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_cascade_order():
    """Rules go by rejections a second among what is left; one that another makes needless comes after those that still
    reject; and the cascade stops at the first rejection."""
    import time

    def rule(name, rejects, seconds):
        def run(f):
            time.sleep(seconds)
            return rejects(int(f.text))

        return quality_rules.Rule(name, run)

    rules = (rule("never", lambda n: False, 0), rule("dear", lambda n: n % 2 == 0, 0.004), rule("cheap", lambda n: n % 3 == 0, 0.0005), rule("same", lambda n: n % 6 == 0, 0.0005))
    fitted = quality_rules.Cascade.fitted([str(n) for n in range(60)], rules)
    assert [r.name for r in fitted.rules][:2] == ["cheap", "dear"] and fitted.stats["cheap"][1] == pytest.approx(1 / 3) and fitted.stats["dear"][1] == pytest.approx(1 / 2) and fitted.stats["same"][1] == 0
    assert fitted.evaluated(quality_rules.Facts("3")) == 1 and fitted.evaluated(quality_rules.Facts("2")) == 2 and fitted.evaluated(quality_rules.Facts("1")) == 4


def test_quality_model_by_numpy(spark):
    """Every score from numpy's means, covariances and log determinants of the training rows, by the plain formula."""
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    x = {i: np.array(quality_model.statistics(t)) for i, t in docs.items()}
    train = {c: np.array([x[i] for i in docs if not held[i] and labels.get(i) == c]) for c in (0, 1)}
    n = {c: len(t) for c, t in train.items()}
    covs = {c: np.cov(t.T, bias=True) for c, t in train.items()}
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / (n[0] + n[1])
    log = {}
    for c in (0, 1):
        shrunk = 0.99 * (0.9 * covs[c] + 0.1 * pooled) + 0.01 * np.trace(pooled) / len(pooled) * np.eye(len(pooled))
        inverse, (_, det) = np.linalg.inv(shrunk), np.linalg.slogdet(shrunk)
        log[c] = {i: -0.5 * ((v - train[c].mean(axis=0)) @ inverse @ (v - train[c].mean(axis=0)) + det) + math.log(n[c]) for i, v in x.items()}
    made = {r["doc_id"]: r for r in quality_model.op5_quality_model(spark, sf).collect()}
    assert set(made) == set(docs) and min(n.values()) > 40
    for i, r in made.items():
        want = 1 / (1 + math.exp(-max(-500, min(500, log[1][i] - log[0][i]))))
        assert r["held_out"] == held[i] and r["score"] == pytest.approx(want, rel=1e-5, abs=1e-7) and r["predicted"] == (r["score"] >= 0.3)


def test_quality_model_held_out(spark, sf):
    made = {r["doc_id"]: r for r in quality_model.op5_quality_model(spark, "/root/testdata/sf0.01").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if made[r["doc_id"]]["held_out"]]
    assert len(labels) > 50 and sum(made[i]["predicted"] == y for i, y in labels) >= 0.95 * len(labels)
    assert all(0 <= r["score"] <= 1 for r in made.values())


def _recall(spark, ids, x, block_bytes, every=20):
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    found = defaultdict(dict)
    usable = neighbours.usable(rows)
    for r in neighbours.search(usable, usable.filter(F.col("vec_id") % every == 0), block_bytes=block_bytes).collect():
        found[r["query_id"]][r["vec_id"]] = r["score"]
    hit = total = 0
    for at in np.flatnonzero(ids % every == 0):
        scores = x @ x[at]
        best = [j for j in np.lexsort((ids, -scores)) if j != at][:20]
        hit, total = hit + len(set(ids[best].tolist()) & set(found[ids[at]])), total + len(best)
        assert len(found[ids[at]]) == len(best) and all(abs(s - scores[np.flatnonzero(ids == v)[0]]) < 1e-12 for v, s in found[ids[at]].items())
    return hit / total


def test_neighbour_recall(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.array([np.asarray(v, np.float64) for v in t.embedding]), t.vec_id.to_numpy()
    assert _recall(spark, ids, x, 40_000) >= 0.9


def test_neighbours_over_blocks(spark):
    """4,000 vectors in some 30 blocks: clusters, where the bound skips blocks, and one large group of copies."""
    from measure_neighbours import vectors

    x = vectors(4000, 40, 16)
    x[1000:2000] = x[1000]
    assert _recall(spark, np.arange(4000), x, 16_384) >= 0.9
    usable = neighbours.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    cells = neighbours._cells(usable, 16_384)
    tops = {s: c.top for s, c in cells.items()}
    p = neighbours.project(x, tops[16], cells[16].matrix)
    number = cells[16].of(p)
    boxes = {16: (np.unique(number), *(np.array([f(p[number == c], axis=0) for c in np.unique(number)]) for f in (np.min, np.max)), np.array([-(-int((number == c).sum()) * 128 // 16_384) for c in np.unique(number)]))}
    queries = usable.filter("vec_id % 20 = 0").withColumn("kth", F.lit(0.95))
    met, blocks = neighbours._asked(queries, cells, boxes, False).count(), int(boxes[16][3].sum())
    assert blocks >= 20 and met < 0.5 * 200 * (blocks - 1)


@pytest.mark.parametrize(("clusters", "most"), [(0, 0.6), (60, 0.05)])
def test_neighbour_stop(clusters, most):
    from measure_neighbours import measured, vectors

    recall, share = measured(vectors(6000, clusters))
    assert recall >= 0.9 and share <= most


def test_copies_with_many_ids():
    """Ids repeat at a point and at several points: each counts once, with its best score."""
    x = np.array([[1.0, 0.0]] * 60 + [[0.9, 0.1]] * 3)
    ids = np.array([5] * 30 + list(range(10, 40)) + [5, 7, 8])
    found, scores = neighbours.Index(ids, x).search(np.array([1.0, 0.0]), 10)
    assert found.tolist() == [5, *range(11, 30)] and set(scores) == {1.0}


def test_chi_square_quantile():
    assert neighbours.chi_square_quantile(0.95, 10) == pytest.approx(18.307, abs=1e-3) and neighbours.chi_square_quantile(0.5, 2) == pytest.approx(1.386, abs=1e-3)


def test_archives_by_bytes(spark, tmp_path):
    """Archives hold so many bytes or one record, whatever the number of records; revisits carry no payload; all comes back."""
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcdef0123456789") for _ in range(rnd.choice([10, 1500, 6000]))) for _ in range(40)]
    rows = [(i, f"http://x/{i}", texts[i % 40]) for i in range(120)] + [(None, "http://y", texts[1])] * 2
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), f"{tmp_path}/a", archive_bytes=8000)
    files = [f.read_bytes() for f in Path(f"{tmp_path}/a").glob("part-*")]
    held = [[m for w, _, _, m in warc.salvage(f) if w == "record"] for f in files]
    assert len(files) > 5 and all(len(f) <= 8000 + len(warc.EMPTY_MEMBER) or len(h) == 1 for f, h in zip(files, held, strict=True))
    made = sorted((r["page_id"] is None, r["page_id"] or 0, r["kind"], r["refers_to"], r["payload"]) for r in warc.read_archives(spark, f"{tmp_path}/a", payloads=True).collect())
    want = []
    for i, _, t in rows:
        again = i is not None and len(t) >= 1000 and i < 80
        want.append((i is None, i or 0, "revisit" if again else "response", 80 + i % 40 if again else None, None if again else t.encode()))
    assert made == sorted(want)


def test_salvage():
    parts = [warc.pack(warc.make_record("response", i, "http://a", b"x" * 50 + bytes([i]), 51, hashlib.sha1(b"x" * 50 + bytes([i])).hexdigest())) for i in range(6)]
    whole = warc.EMPTY_MEMBER.join(parts) + warc.EMPTY_MEMBER
    assert [m["page_id"] for w, _, _, m in warc.salvage(whole) if w == "record"] == list(range(6))
    at = whole.index(parts[2])
    for damage in (b"\0" * 30, b"", b"\x1f\x8b\x08garbage"):
        broken = whole[: at + 20] + damage + whole[at + 50 :]
        out = list(warc.salvage(broken))
        assert [m["page_id"] for w, _, _, m in out if w == "record"] == [0, 1, 3, 4, 5]
        gaps = [(a, n) for w, a, n, _ in out if w == "gap"]
        assert gaps[0][0] == at and sum(n for _, n in gaps) >= len(parts[2]) - 30
    cut = list(warc.salvage(whole[: at + 40]))
    assert cut[-1][0] == "gap" and cut[-1][1:3] == (at, 40)
    plain = b"".join(warc.make_record("response", i, None, b"p", 1, hashlib.sha1(b"p").hexdigest()) for i in range(3))
    bad = plain.replace(b"Content-Length: 1\r\n\r\np", b"Content-Length: 1\r\n\r\nq", 1)
    out = list(warc.salvage(bad))
    assert [w for w, *_ in out] == ["gap", "record", "record"] and out[0][3] == "payload digest"
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"junk"))[0][:3] == ("gap", 0, 4)


def test_main_text():
    para = "A paragraph of prose, with commas, that is long enough to score well; it goes on &amp; on."
    page = f'<header class="site-header">Site, name</header><div class="cookie-notice"><p>{para} cookies</p></div><div class="c"><h1>T</h1><div><p>{para}<p>Short.<ul><li>one<li>two</ul><div class="ad">{para}</div><form>{para}</form></div></div><aside><p>{para}</p></aside><div id="comments"><article class="comment"><p>{para}</p></article></div><footer>f</footer><script>if(a<b)"</p>"</script>'
    clean = para.replace("&amp;", "&")
    assert html_text.main_text(page) == f"T {clean} Short. one two"
    assert html_text.main_text("<article><header><h1>T</h1></header><section><p>" + para + "</section><section><p>" + para + "</section></article>") == f"T {clean} {clean}"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("plain text, no markup") == "plain text, no markup"
    assert len(html_text.main_text("<div>" * 3000 + para)) == len(clean)


def test_main_text_of_deep_pages_is_linear():
    import time

    def seconds(depth):
        page, began = "<div class=x>" * depth + "<p>" + "Prose, with commas. " * 20, time.perf_counter()
        assert html_text.main_text(page).startswith("Prose")
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(16_000) < 16 * max(seconds(2000), 0.01)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<a href='x'>", "</a>", "<li>", "<td>", "<table>", "</table>", "text, more", "<", ">", "&amp", "&#x41;", "<!--", "-->", "<script>", "</script>", "<br/>", '<p class="x', "<article>", "</article>", "</body>"]), max_size=30))
def test_main_text_survives(parts):
    text = html_text.main_text(" ".join(parts))
    assert text == " ".join(text.split())


def test_pages_of_the_tables(spark, sf):
    import html

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        assert html_text.main_text(r["html"]) == want


def test_pipeline(spark, sf, texts):
    import corpus_pipeline

    read = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality(spark, docs, sf)
    want = {i: t for i, t in texts.items() if quality_rules.Cascade().keeps(quality_rules.Facts(t))}
    assert read(kept) == want and kept.columns == columns
    once = corpus_pipeline.near_duplicates(spark, kept, sf)
    groups = _components(want, 5)
    want = {i: t for i, t in want.items() if groups[i][1] == i}
    assert read(once) == want and once.columns == columns
    clean = corpus_pipeline.personal_data(spark, once, sf)
    assert clean.columns == columns and not any(_base_spans(t) for t in read(clean).values())
    assert all(read(clean)[i] == t for i, t in want.items() if not _base_spans(t))
    mixed = corpus_pipeline.mixed(spark, clean, sf)
    assert mixed.columns == columns and set(read(mixed)) <= set(want) and set(Counter(r["doc_id"] for r in mixed.collect()).values()) <= {1, 2}
    last = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r["doc_id"] for r in last) == Counter(r["doc_id"] for r in mixed.collect()) and all(len(r["ids"]) == r["n_tokens"] for r in last)
