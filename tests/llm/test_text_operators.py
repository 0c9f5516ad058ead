"""Operators on documents against brute-force versions, over odd cases: nulls, empty and long texts, ties,
repeated rows, empty tables and clashing column names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quoin.llm import bpe, classifier, licenses, ngram_join, packing, pieces, rules, suffixes, wavelet
from quoin.llm.common import components, shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count long, row_key string, key int"
RNG = random.Random(11)
WORDS = ["the", "of", "Alpha", "beta", "gamma!", "日本", "é́", "x" * 30, "#tag", "12", "cc", "by", "all", "rights", "reserved"]


def prose(n, rng=RNG):
    return rng.choice(["", " ", "\n"]).join([""] * rng.randint(0, 2)) + " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", "\n"]) for _ in range(n))


def corpus():
    texts = [prose(RNG.randint(1, 160)) for _ in range(40)]
    near = [t + " extra words here" for t in texts[:8]]
    texts += texts[:10] + near + ["", " \n\t ", None, "one", "a b c", "%" * 300, "a\n" * 400, "word " * 3000, prose(4000)]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    rows += [(None, texts[0]), (None, None), rows[2], (9, texts[0] + " other text of the same id")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "r", 2) for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3 * i, i % 2, None) for i in range(60)] + [(None, 1, 0), (3, None, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")


def tuples(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def words_of(text):
    return [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]


def test_quality_rules(spark, docs, labels, rows):
    got = rules.judge(docs, labels)
    want = Counter()
    for i, t in rows:
        w = words_of(t)
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {p for j, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for p in (j, j + 1, j + 2)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), failed] += 1
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert tuples(got, *cols) == want
    assert not got.where("base_failed and kept").count()
    assert not rules.judge(docs.limit(0), labels.limit(0)).count()


def test_rules_control_false_rejection(spark):
    """A cutoff is passed only where the exact binomial test passes, and rejects what it should."""
    good = [(i, " ".join(f"w{j}" for j in range(i, i + 60)), "en") for i in range(3000)]
    bad = [(5000 + i, " ".join(f"w{j}$$$$" for j in range(i, i + 60)), "en") for i in range(200)]
    few = [(9000 + i, " ".join(f"w{j}$$$$" for j in range(i, i + 60)), "xx") for i in range(20)]
    docs = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad + few], "doc_id long, quality int")
    kept = {r.doc_id for r in rules.judge(docs, labels).where("kept").collect()}
    assert kept == {i for i, *_ in good} | {i for i, *_ in few}  # the small stratum cannot pass the test
    same = docs.withColumn("text", docs.text.substr(1, 0)).selectExpr("doc_id", "if(doc_id < 5000, repeat('a b c d e f ', 20), repeat('a $ c d e f ', 20)) text", "lang")
    judged = rules.judge(same, labels)  # thousands of copies are one trial, which proves nothing
    assert judged.where("not base_failed and not kept").count() == 0


def brute_kept(rows, quality, alpha, delta):
    """Verdicts from the plain definition. rows: id, text, language."""
    values = {
        "repeated": lambda w, t: sum(rules_covered(w)) / max(len(w), 1),
        "symbols": lambda w, t: sum(c in "#*$%&|<>" for c in t) / max(sum(map(len, w)), 1),
        "dup_lines": lambda w, t: (len(x := [y for y in t.split("\n") if y.strip(" \t\r\x0b\x0c")]) - len(set(x))) / max(len(x), 1),
        "capitals": lambda w, t: sum("A" <= c <= "Z" for c in t) / max(sum(map(len, w)), 1),
        "marks": lambda w, t: sum(c in "!?" for c in t) / max(sum(map(len, w)), 1),
        "long_words": lambda w, t: sum(map(len, w)) / max(len(w), 1),
    }

    def rejected(t, k):
        w = words_of(t)
        return any(values[r](w, t) > grid[k] for r, (_, grid) in rules.RULES.items())

    passes_base = {i: len(w := words_of(t)) >= 50 and 100 * sum(rules_covered(w)) <= 50 * len(w) for i, t, _ in rows}
    trials = {}
    for i, t, lang in rows:
        if passes_base[i] and i in quality:
            trials[lang, t] = min(quality[i], trials.get((lang, t), 1))
    m, chosen = max(1, len({x for x, _ in trials})), {}
    for lang in {x for x, _ in trials}:
        good, bad = ([t for (x, t), q in trials.items() if x == lang and q == v] for v in (1, 0))
        best = 0
        for k in range(rules.LEVELS):
            g, b = (sum(rejected(t, k) for t in x) for x in (good, bad))
            n = len(good)
            if not n or g > n * alpha or sum(math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(g + 1)) > delta / m:
                break
            if b - g > best:
                best, chosen[lang] = b - g, k
    return {i: passes_base[i] and not (lang in chosen and rejected(t, chosen[lang])) for i, t, lang in rows}


def rules_covered(w):
    grams = Counter(zip(w, w[1:], w[2:]))
    at = {p for j, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for p in (j, j + 1, j + 2)}
    return [j in at for j in range(len(w))]


def test_rule_levels_equal_brute_force(spark):
    rng = random.Random(9)
    rows, quality = [], {}
    for i in range(1500):
        lang, bad = rng.choice(["en", "en", "en", "de"]), rng.random() < 0.2
        mark = rng.choice(["$", "!", "X", "é"]) * rng.randint(0, 3) if bad or rng.random() < 0.02 else ""
        rows.append((i, " ".join(f"w{rng.randint(0, 500)}" + mark * (rng.random() < 0.7) for _ in range(rng.randint(40, 90))), lang))
        if rng.random() < 0.9:
            quality[i] = int(not bad)
    rows += [(3000 + k, *rows[k][1:]) for k in range(40)]
    quality |= {3000 + k: 1 - quality.get(k, 1) for k in range(40)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(list(quality.items()), "doc_id long, quality int")
    for alpha, delta in ((0.02, 0.05), (0.05, 0.2), (0.001, 0.05)):
        got = {r.doc_id: r.kept for r in rules.judge(docs, labels, alpha, delta).collect()}
        assert got == brute_kept(rows, quality, alpha, delta)
    assert sum(not x for x in got.values()) < sum(not x for x in brute_kept(rows, quality, 0.05, 0.2).values())


def brute_join(rows, n, percent):
    sets = []
    for _, t in rows:
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("n,percent,often,hot", [(4, 85, 2, 64), (3, 50, 1, 2), (1, 30, 100, 3)])
def test_ngram_join(docs, rows, n, percent, often, hot):
    got = ngram_join.jaccard_components(docs, n, percent, frequent_from=often, frequent_max=50, hot_from=hot)
    assert tuples(got, "doc_id", "n_shingles", "component_id") == brute_join(rows, n, percent)


def test_ngram_join_empty(docs):
    assert not ngram_join.jaccard_components(docs.limit(0)).count()


def test_prefix_tree():
    rng = np.random.default_rng(0)
    for _ in range(60):
        base = np.unique(rng.integers(0, 300, rng.integers(1, 90)).astype(np.uint64))

        def vary():
            s = set(base.tolist())
            for _ in range(rng.integers(0, len(base) // 2 + 2)):
                s.symmetric_difference_update([int(rng.integers(0, 300))])
            return np.array(sorted(s or {1}), np.uint64)

        sets, percent = [vary() for _ in range(20)], int(rng.choice([50, 80, 85, 100]))
        tree = ngram_join.PrefixTree(sets)
        for query in (vary(), vary(), sets[3]):
            among = (rng.random(20) < 0.7).tolist()
            want = [i for i, x in enumerate(sets) if 100 * len(np.intersect1d(x, query)) >= percent * len(np.union1d(x, query))]
            assert sorted(tree.links(query, percent, step=int(rng.choice([1, 3, 64])))) == want
            assert sorted(tree.links(query, percent, among)) == [i for i in want if among[i]]


def test_ngram_join_of_many_copies_makes_one_set_for_each_class(spark, monkeypatch):
    made = []
    materialize = ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, tag: made.append((tag, out := materialize(df, tag))) or out)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text)] * 10_000 + [(None, text)] * 50 + [(9, text + " more"), (3, "others have this text of their own"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.jaccard_components(docs, 4, 85).groupBy("doc_id", "component_id", "n_shingles").count().collect()
    assert {tuple(r) for r in got} == {(7, 7, 57, 10_000), (None, 7, 57, 50), (9, 7, 58, 1), (3, 3, 4, 1), (4, 4, 0, 1)}
    assert [df.count() for tag, df in made if tag == "sets"] == [2, 0]


def test_packing(docs, rows):
    enc = bpe.encoder()
    got = packing.pack(docs, capacity=64).toPandas()
    want = Counter()
    total = 0
    for i, t in rows:
        ids = np.append(enc.encode(t or ""), 2).astype("<u4")
        total += len(ids)
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    plain = got[["doc_id", "piece", "start", "length", "ids_crc32"]]
    assert Counter((None if d != d else int(d), *map(int, r)) for d, *r in plain.itertuples(index=False)) == want
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    sums = got.groupby("sequence_id").length.sum()
    assert sums.max() <= 64 and len(sums) <= -(-total // 64) + 2
    assert not packing.pack(docs.limit(0)).count()


def test_packing_search_keeps_pieces_and_gains():
    for seed in range(5):
        rng = random.Random(seed)
        h = Counter(rng.choice([330, 350, 400, 600, rng.randint(1, 1024)]) for _ in range(800))
        before = packing.best_fit(h, 1024)
        after = packing.improve(before, 1024)
        back = Counter()
        for p, n in after.items():
            assert sum(p) <= 1024
            for x in p:
                back[x] += n
        squares = lambda c: sum(n * sum(p) ** 2 for p, n in c.items())
        assert back == h and sum(after.values()) <= sum(before.values()) and squares(after) >= squares(before)


def test_packing_search_gives_two_for_one_and_ends_when_no_step_gains():
    assert packing.improve(Counter({(10, 7): 1, (5, 4): 1}), 20) == Counter({(10, 5, 4): 1, (7,): 1})
    for seed in range(5):
        rng = random.Random(seed)
        after = packing.improve(packing.best_fit(Counter(rng.randint(200, 1024) for _ in range(400)), 1024), 1024)
        assert packing.improve(after, 1024) == after


def test_byte_bpe_equals_the_library():
    enc = bpe.encoder()
    for _ in range(400):
        t = "".join(RNG.choice([" ", "  ", "\n", "a", "the", "'s", "é", "日", "12", "!!", "<|endoftext|>", "\x1c", "　", "½", "😀"]) for _ in range(RNG.randint(0, 14)))
        assert enc.encode(t).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("run", [" " * 2_000_000, "\n" * 2_000_000, "\t" * 2_000_000, "a b" + " \n\t" * 700_000 + "c", "word " * 9 + " " * 2_000_000 + "end"])
def test_byte_bpe_of_long_white_space_equals_the_library(run):
    enc = bpe.encoder()
    assert enc.encode(run).tolist() == enc.tokenizer.encode(run, add_special_tokens=False).ids


def test_shards_and_packing_of_long_white_space(spark):
    docs = spark.createDataFrame([(1, " " * 2_000_000), (2, "\n" * 1_500_000 + "x")], "doc_id long, text string")
    enc = bpe.encoder()
    want = {r.doc_id: len(enc.encode(r.text)) + 1 for r in docs.collect()}
    shards = wavelet.read_shards(wavelet.write_shards(docs, f"{shared_dir(spark)}/white"))
    assert {r.doc_id: r.n_tokens for r in shards.collect()} == want
    assert {r.doc_id: r.n for r in packing.pack(docs).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()} == want


def test_token_shards(spark, docs, rows):
    enc = bpe.encoder()
    manifest = wavelet.write_shards(docs, f"{shared_dir(spark)}/test-shards", shard_tokens=500, shards=2)
    got = wavelet.read_shards(manifest).toPandas()
    assert manifest.count() > 2
    want = Counter()
    for i, t in rows:
        ids = np.append(enc.encode(t or ""), 0).astype("<u4")
        want[i, len(ids), zlib.crc32(ids)] += 1
    assert Counter((None if d != d else int(d), int(n), int(c)) for d, n, c in got[["doc_id", "n_tokens", "ids_crc32"]].itertuples(index=False)) == want
    by_place = got.sort_values("start")
    assert (by_place.start == by_place.n_tokens.cumsum() - by_place.n_tokens).all()
    known = by_place.doc_id.dropna()
    assert (known.diff().dropna() >= 0).all()
    assert not wavelet.read_shards(wavelet.write_shards(docs.limit(0), f"{shared_dir(spark)}/none")).count()


def test_wavelet_matrix(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 64)
    ids = np.random.default_rng(1).integers(0, 40, 700).astype(np.uint32)
    ids[5] = 50256
    uri = wavelet.write_file(f"{shared_dir(spark)}/one", "t", wavelet.build(ids, 16, np.array([1, 2]), np.array([0, 300])))
    shard = wavelet.WaveletShard(uri, hold=8)
    assert shard.decode().tolist() == ids.tolist()
    assert [shard.access(i) for i in range(0, 700, 37)] == ids[::37].tolist()
    for t in (0, 7, 39, 50256, 41):
        assert list(shard.locate(t)) == np.flatnonzero(ids == t).tolist()
        assert shard.count(t, 100, 401) == int((ids[100:401] == t).sum())


def test_license_scan(docs, rows):
    want = Counter()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
        at, found = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            here = [j for j in range(len(w)) if w[j : j + len(p)] == p]
            at += here
            found |= {label} if here else set()
        want[i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found))] += 1
    got = licenses.scan(docs)
    assert tuples(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    assert not licenses.scan(docs.limit(0)).count()


def variants(tree):
    """Strings that a parsed regex matches: each branch, option and letter of a class, ranges by one."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            ways = [chr(arg)]
        elif name == "NOT_LITERAL":
            ways = ["q"]
        elif name == "IN":
            ways = ["q"] if str(arg[0][0]) == "NEGATE" else [chr(v if str(k) == "LITERAL" else v[0]) for k, v in arg]
        elif name == "BRANCH":
            ways = [w for b in arg[1] for w in variants(b)]
        elif name == "SUBPATTERN":
            ways = variants(arg[3])
        elif name == "MAX_REPEAT":
            ways = [""] * (arg[0] == 0) + variants(arg[2])
        else:
            raise ValueError(name)
        out = [a + b for a in out for b in ways]
    return out


def test_license_keywords_are_in_all_their_rules_match():
    for label, _, keyword, regex in licenses.signatures():
        for v in variants(re._parser.parse(regex)):
            assert re.fullmatch(regex, v) and keyword in v, (label, keyword, v)
            assert any(x in v for x in licenses.STEMS) or re.search(licenses.STEM_PAIR, v), (label, v)


def brute_labels(text):
    """Labels and score by every rule on every text, and every pair of detections."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(fold))
    line = " " + " ".join(words) + " "
    found = set()
    for rule, (label, priority, _, regex) in enumerate(licenses.signatures()):
        for m in re.finditer(rf"(?<= )(?=({regex})(?= ))", line):
            start = line[: m.start()].count(" ") - 1
            found.add((start, start + len(m[1].split()), priority, rule, label))

    def hides(a, b):
        same = a[:2] == b[:2]
        return a[0] <= b[0] and b[1] <= a[1] and (a[2] > b[2] or a[2] == b[2] and (not same or a[3] < b[3]))

    stay = [b for b in found if not any(hides(a, b) for a in found)]
    base = {label for phrase, label in licenses.BASE.items() if f" {phrase} " in line}
    weights = [licenses.WEIGHT[x[2]] for x in stay] + [licenses.WEIGHT[licenses.NAME]] * bool(base)
    return ",".join(sorted({x[4] for x in stay} | base)), max(weights, default=0.0)


def test_license_labels_and_scores(spark):
    """All rules' own strings, alone and in company, against brute force."""
    rng = random.Random(3)
    all_of = [variants(re._parser.parse(regex)) for *_, regex in licenses.signatures()]
    strings = [v for x in all_of for v in rng.sample(x, min(2, len(x)))]
    texts = strings + [rng.choice([" ", "-", ", "]).join(rng.choice([*strings, "the", "License", "v2", "or later", "CC BY"]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    texts = [t.upper() if rng.random() < 0.3 else t for t in texts] + ["", None, "\u212aey copyright", "no such words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_labels(t), (i, t)


def test_license_versions_in_all_spellings(spark):
    texts = {"GPL-2.0": "gpl-2.0", "GPL v3": "gpl-3.0", "LGPL-2.1": "lgpl-2.1", "AGPL-3.0": "agpl-3.0", "GPLv2": "gpl-2.0", "Apache Licence, Version 2.0": "apache-2.0", "GNU General Public Licence version 2": "gpl,gpl-2.0"}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    have = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan(docs).collect()}
    for i, want in enumerate(texts.values()):
        assert set(want.split(",")) - {"gpl"} <= have[i], (i, have[i])


def test_license_suppression(spark):
    texts = {
        1: ("Licensed under the Apache License, Version 2.0", "apache-2.0,licensed"),
        2: ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0"),
        3: ("GNU Lesser General Public License v2.1 or any later version", "gpl,lgpl-2.1-or-later"),
        4: ("CC BY-SA 4.0", "cc-by,cc-by-sa-4.0"),
        5: ("no license", ""),
        6: ("", ""),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(docs).collect()} == {i: x for i, (_, x) in texts.items()}


def test_classifier(spark, docs, labels, rows):
    got = classifier.score(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert len({r.score for r in got if r.doc_id == rows[2][0]}) == 1
    assert {r.score for r in classifier.score(docs, labels.limit(0)).collect()} == {0.5}
    assert not classifier.score(docs.limit(0), labels).count()


def test_classifier_held_out_accuracy(spark):
    rng = random.Random(5)
    good = ["market", "season", "harbour", "village", "teacher"]
    bad = ["BUY!!", "click$$", "WIN!!!", "free%%"]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad) + str(rng.randint(0, 99)) for _ in range(80)), int(i % 3 > 0)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = classifier.score(docs.select("doc_id", "text"), docs.select("doc_id", "quality")).join(docs, "doc_id").where("held_out")
    assert got.where("predicted = quality").count() >= 0.97 * got.count() > 0


def test_piece_encoding(docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.PIECE_BPE))
    want = Counter()
    for i, t in rows:
        ids = sp.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert tuples(pieces.piece_digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    back = pieces.decode_pieces(pieces.encode_pieces(docs))
    assert tuples(back, "doc_id", "text") == Counter((i, sp.decode(sp.encode(t or ""))) for i, t in rows)
    assert not pieces.piece_digests(docs.limit(0)).count()


def test_piece_encoding_of_odd_texts():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.PIECE_BPE))
    held = pieces.prefix_table()
    parts = [" ", "  ", "\n", "a", "the", "é", "日", "12", "<s>", "\x1c", "　", "x" * 20, "▁", "▁▁▁", "😀", "\x00", "𝒳", "ing", " the", "�"]
    texts = ["".join(RNG.choice(parts) for _ in range(RNG.randint(0, 14))) for _ in range(500)] + [" " * k + "a" for k in range(40)] + [" " * k for k in range(40)]
    for t in texts:
        ids = sp.encode(t)
        assert held.encode(t) == ids and held.decode(ids) == sp.decode(ids)
    for _ in range(300):
        ids = [RNG.choice([RNG.randrange(32000), RNG.randrange(262)]) for _ in range(RNG.randint(0, 8))]
        assert held.decode(ids) == sp.decode(ids)


def brute_repeats(rows, length):
    first = {}
    for d, t in sorted((d, t or "") for d, t in rows if d is not None):
        b = t.encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], d)
    want = Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if d is not None and first[b[p : p + length]] < d:
                gone[p : p + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[d, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return want


@pytest.mark.parametrize("length,k,hot", [(50, 20, 1 << 16), (12, 7, 1 << 16), (50, 20, 3), (12, 7, 2)])
def test_suffix_dedup(docs, rows, length, k, hot):
    got = suffixes.remove_repeats(docs, length, k, group_bytes=2000, hot_from=hot, keep=("key", "row_key"))
    assert tuples(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, length)
    assert got.columns[-3:] == ["key", "row_key", "kept_text"] and not got.where("key <> 2 or row_key <> 'r'").count()
    assert not suffixes.remove_repeats(docs.limit(0)).count()


def test_suffix_dedup_of_long_texts_and_nulls(spark):
    rng = random.Random(8)
    letters = "".join(rng.choice("abcdé ") for _ in range(600_000))
    rows = [(5, letters), (9, letters[:200_000] + "#" + letters[300_000:]), (2, "z" * 900_000), (3, "z" * 60), (None, letters), (None, None), (9, letters[:70])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.remove_repeats(docs, group_bytes=1 << 20, hot_from=2)
    assert tuples(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, 50)


def test_suffix_arrays_are_in_the_order_of_the_bytes():
    rng = np.random.default_rng(2)
    for length in (2, 5, 12, 50):
        text = rng.integers(0, 3, (60, 80)).astype(np.uint8)
        counts, docs = rng.integers(1, 80 - length + 2, 60), np.sort(rng.integers(0, 30, 60))
        got = suffixes.SuffixArray(text, counts, docs, length)
        least = {}
        for r in range(60):
            for c in range(counts[r]):
                least.setdefault(text[r, c : c + length].tobytes(), docs[r])
        assert [bytes(x) for x in got.keys.view(np.uint8).reshape(-1, length)] == sorted(least)
        assert got.docs.tolist() == [least[x] for x in sorted(least)]
        assert all(text[r, c : c + length].tobytes() == bytes(got.keys[g : g + 1].view(np.uint8)) for r, c, g in zip(*got.places, got.group))


def test_index_family_levels():
    """Batches against a dictionary; levels stay sorted, share no string and grow geometrically."""
    rng, family, seen = np.random.default_rng(2), suffixes.IndexFamily(), {}
    for doc in range(200):
        text = rng.integers(0, 4, (10, 8)).astype(np.uint8)
        batch = suffixes.SuffixArray(text, np.full(10, 4), np.full(10, doc), 5)
        strings = [bytes(x) for x in batch.keys.view(np.uint8).reshape(-1, 5)]
        got = family.add(batch)
        for x in strings:
            seen.setdefault(x, doc)
        assert got.tolist() == [seen[x] for x in strings]
    sizes = [len(k) for k, _ in family.levels]
    assert sum(sizes) == len(seen) and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    for keys, docs in family.levels:
        strings = [bytes(x) for x in keys.view(np.uint8).reshape(-1, 5)]
        assert strings == sorted(strings) and docs.tolist() == [seen[x] for x in strings]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 501 + i) for i in range(80)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(30)] + [(700, 700)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert not components(spark.createDataFrame([], "a long, b long")).count()


def test_ngram_join_makes_sets_only_of_pairs_that_may_link(spark, monkeypatch):
    made = []
    materialize = ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, tag: made.append((tag, out := materialize(df, tag))) or out)
    words = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    rows = [(i, words(f"own{i}x", 150) + " " + words("common", 150)) for i in range(20)]  # meet, but share a half
    rows += [(30, words("near", 200)), (31, words("near", 200) + " more"), (40, words("long", 70_000)), (41, words("long", 70_000) + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.jaccard_components(docs, 4, 85, frequent_max=0)
    assert tuples(got, "doc_id", "n_shingles", "component_id") == brute_join(rows, 4, 85)
    assert [df.count() for tag, df in made if tag == "sets"] == [4, 0]


def test_suffix_dedup_packs_documents_tightly(spark):
    rng = random.Random(12)
    rows = [(i, i, " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(900))) for i in range(60)]
    packed = suffixes.packed_groups(spark.createDataFrame(rows, "doc_id long, row_key long, text string"), 1).first()["docs"]
    sink = pa.BufferOutputStream()
    docs = suffixes._documents(packed)
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(docs)
    assert docs.num_rows == 60 and len(packed) < 0.98 * sink.getvalue().size


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_ngram_join_sends_little(spark, docs, rows, monkeypatch, few):
    docs = spark.createDataFrame(docs.dropDuplicates(["doc_id", "text"]).collect(), docs.schema)
    plans = {}
    materialize = ngram_join.materialize
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ngram_join, "materialize", lambda df, tag: plans.setdefault(tag, []).append(plan(df)) or materialize(df, tag))
    for name, value in (("ENTRIES", 5), ("COMPONENTS", 1), ("FEW", few)):
        monkeypatch.setattr(ngram_join, name, value, raising=False)
    got = ngram_join.jaccard_components(docs, 3, 50, frequent_max=50, hot_from=4)
    assert set(tuples(got, "doc_id", "n_shingles", "component_id")) == set(brute_join(rows, 3, 50))
    assert [p.count("Exchange hashpartitioning") for p in plans["pairs"]] == [1]  # pairs; entries stay in place
    if few:
        assert all("Exchange hashpartitioning" not in p for p in plans["sets"])
