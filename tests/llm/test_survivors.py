"""Best representative: alignment, dominance against brute force, buckets, defined results."""

import random

import pandas as pd

from shelfmark.llm import survivors as V

DOC = "doc_id bigint, sha256 string, file_name string, source string, last_seen_job string, metadata_title string, metadata_author string, metadata_creator string, metadata_created string, metadata_modified string, filled int, weight string"


def tables(spark, docs, paths=()):
    jobs = spark.sql("SELECT * FROM VALUES ('j1', timestamp_ntz '2020-01-01 00:00:00'), ('j2', timestamp_ntz '2021-01-01 00:00:00'), ('j3', timestamp_ntz '2022-01-01 00:00:00') AS t(job_id, run_at)")
    sources = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "source string, trust_rank int")
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(list(paths), "id bigint, sha256 string, rel_path string"), jobs, sources


def doc(i, sha, name, source="a", job="j1", title=None, author=None):
    return (i, sha, name, source, job, title, author, None, None, None, 7, "w")


def brute(docs):
    run, trust = {"j1": 1, "j2": 2, "j3": 3, None: 0}, {"a": -1, "b": -2, "c": -3, None: -9}
    filled = lambda d: sum(bool((x or "").strip()) and x.strip().lower() not in V.PLACEHOLDERS for x in d[5:10])
    score = {d[0]: (filled(d), run[d[4]], trust[d[3]]) for d in docs}
    out = set()
    for d in docs:
        others = [e for e in docs if e[1] == d[1] and e[0] != d[0]]
        if d[1] and others and all(all(x >= y for x, y in zip(score[d[0]], score[e[0]])) and score[d[0]] != score[e[0]] for e in others):
            out.add((d[1], d[0]))
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    docs = [doc(i, r.choice(["s1", "s2", "s3", "s4", "s5", None]), f"n{i}.pdf", r.choice("abc"), r.choice(["j1", "j2", "j3", None]), r.choice(["T", None, " ", "n/a"]), r.choice(["A", "unknown", None])) for i in range(14)]
    for seed in range(3):
        r.seed(seed)
        some = r.sample(docs, 10)
        got = {(x.sha256, x.doc_id) for x in V.dominant_rows(V.surviving_records(*tables(spark, some))).collect()}
        assert got == brute(some)


def test_record(spark):
    docs = [doc(1, "s", "Guide to Rivers_v2.pdf", "b", "j1", "Rivers"), doc(2, "s", "Guide to Rivers.pdf", "a", "j3", "Rivers", "N. Body"), doc(3, "s", "Guide to Rivres.pdf", "c", "j2", "unknown"), doc(4, "t", "alone.pdf")]
    digest = "a" * 64
    docs = [(*d[:1], digest if d[1] == "s" else d[1], *d[2:]) for d in docs]
    paths = [(9, digest.upper() + " ", "x/Guide to Rivers.pdf"), (5, "sha256:" + digest, "y/Guide to Rivers.pdf"), (6, digest, "y/Guide to Rivers.pdf"), (1, digest, "y/other.pdf"), (2, None, None)]
    (r,) = V.surviving_records(*tables(spark, docs, paths)).collect()
    assert (r.doc_id, r.path_id, r.dominates, r.file_name, r.metadata_title, r.metadata_author, r.metadata_creator) == (2, 5, True, "Guide to Rivers.pdf", "Rivers", "N. Body", None)


def test_consensus():
    p = V.merge_profiles([V._profiles(__import__("pandas").Series([[{"value": v, "weight": w} for v, w in (("a b c", 1.0), ("a c", 1.0), ("a b d c", 0.5))]]))[0]])
    assert "".join(V.consensus_tokens(p)) == "a b c"
    assert V.distance("a b c", V.consensus_tokens(p)) == 0 and V.distance("a x c", V.consensus_tokens(p)) == 1


def test_buckets_give_the_same_record(spark):
    votes = spark.createDataFrame([("k", "f", f"Handbook of Rivers {'x' * (i % 3)} {i}", 1.0) for i in range(60)] + [("k", "f", "Handbook of Rivers", 30.0)], "key string, field string, value string, weight double")
    assert V.consensus_values(votes, 8).first().value == V.consensus_values(votes, 1000).first().value == "Handbook of Rivers"


def test_votes_dropped_in_a_bucket_count(spark):
    """A token outvoted in one bucket by one heavy value, with most of the weight over all."""
    heavy, light = [("Rivers Guide", 1000.0)], [(f"Rivers X Guide {i}", 100.0) for i in range(3)]
    other = [("Rivers X Guide", 801.0)]
    parts = V._profiles(pd.Series([[{"value": v, "weight": w} for v, w in b] for b in (heavy + light, other)]))
    merged = V.merge_profiles(parts)
    rows = [("k", "f", v, w) for v, w in heavy + light + other]
    votes = spark.createDataFrame(rows, "key string, field string, value string, weight double")
    profiles = spark.createDataFrame([("k", "f", merged)], "key string, field string, profile string")
    assert "".join(V.consensus_tokens(merged)) == "Rivers Guide"
    assert "".join(V.consensus_tokens(V.recounted(profiles, votes).first().profile)) == "Rivers X Guide"


def test_long_values_are_aligned(monkeypatch):
    r = random.Random(1)
    a = [r.choice("abcdefgh") for _ in range(120)]
    b = [x for x in a if r.random() > 0.2]
    one = lambda v: [{t: 1.0} for t in v]
    score = lambda p: sum(V.MATCH if len(c) == 1 and "" not in c else V.GAP if "" in c else V.CHANGED for c in p)
    want, far = score(V._align(one(a), 1.0, one(b), 1.0)), V.distance("".join(f"{x} " for x in a), [t for x in b for t in (x, " ")])
    monkeypatch.setattr(V, "TABLE", 50)
    assert abs(score(V._align(one(a), 1.0, one(b), 1.0)) - want) < 1e-9
    assert V.distance("".join(f"{x} " for x in a), [t for x in b for t in (x, " ")]) == far


def test_edges(spark):
    assert V.surviving_records(*tables(spark, [])).count() == 0
    twins = [doc(1, "s", "n.pdf"), doc(2, "s", "n.pdf"), doc(2, "s", "n.pdf")]
    (r,) = V.surviving_records(*tables(spark, twins)).collect()
    assert r.dominates is False and r.doc_id == 1 and r.file_name == "n.pdf" and r.path_id is None
    long = [doc(1, "s", "w " * 3000 + "a"), doc(2, "s", None), doc(3, "s", "w " * 3000 + "b")]
    assert V.surviving_records(*tables(spark, long)).count() == 1


def planted(groups, seed=7):
    """Names with copies: the original is the value of most weight in one group out of two, everywhere it is what the copies have in common."""
    r = random.Random(seed)
    words = "river delta lantern harbor willow copper meadow signal orchard turbine glacier lattice".split()
    rows, originals = [], {}
    for g in range(groups):
        name = " ".join(r.choice(words).title() for _ in range(r.randrange(2, 6))) + ".pdf"
        originals[f"g{g}"] = name
        rows.append((f"g{g}", "f", name, 1.0))
        for _ in range(r.randrange(3, 9)):
            parts = name[:-4].split(" ")
            i = r.randrange(len(parts))
            how = r.randrange(4)
            if how == 0:
                parts[i] = parts[i][:-1]
            elif how == 1:
                parts[i] = parts[i] + r.choice("abcdef")
            elif how == 2:
                parts.append(r.choice(["copy", "final", "v2", "(1)"]))
            else:
                parts[i] = r.choice(words)
            rows.append((f"g{g}", "f", " ".join(parts) + ".pdf", r.choice([1.0, 1.0, 1.3])))
    return rows, originals


def test_planted_originals_survive(spark):
    rows, originals = planted(150)
    votes = spark.createDataFrame(rows, "key string, field string, value string, weight double")
    got = {r.key: r.value for r in V.consensus_values(votes).collect()}
    right = sum(got[k] == v for k, v in originals.items())
    assert right / len(originals) >= 0.9, right  # in the others more weight has the same damage than none


def test_any_bucket_gives_the_same_values(spark):
    r = random.Random(5)
    rows = []
    for g in range(6):
        name = f"Handbook of {'Tidal Rivers and Lakes'[: 8 + 2 * g]} Part {g}"
        rows += [(f"k{g}", "f", name, 5.0)]
        for i in range(80):
            at = r.randrange(len(name))
            rows.append((f"k{g}", "f", name[:at] + r.choice("xyz") + name[at + r.randrange(2) :] + (f" {i}" if i % 5 == 0 else ""), r.choice([1.0, 2.0])))
    votes = spark.createDataFrame(rows, "key string, field string, value string, weight double")
    want = {(x.key, x.value) for x in V.consensus_values(votes, 1000).collect()}
    for bucket in (4, 16, 64):
        assert {(x.key, x.value) for x in V.consensus_values(votes, bucket).collect()} == want, bucket


def test_ten_thousand_tokens(spark):
    tail = " ".join(f"w{i % 97}" for i in range(5000))
    votes = spark.createDataFrame([("k", "f", v, w) for v, w in ((f"a {tail}", 1.2), (f"b {tail}", 1.0), ("q", 1.0))], "key string, field string, value string, weight double")
    assert V.consensus_values(votes).first().value == f"a {tail}"
