"""The pipeline's stages, each against a brute-force version on a small table."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from semforge.llm import mixing
from tests.llm.test_text_operators import DOC, slow_fingerprint


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    parts = {"aa": ["ka", "to", "mi", "ra", "lo"], "bb": ["ung", "ich", "zu", "ber", "tz"]}
    word = lambda x: "".join(rng.choice(parts[x], int(rng.integers(2, 4))))
    item = " ".join(word("aa") for _ in range(30))
    rows = []
    for i in range(240):
        lang = ["aa", "bb"][i % 2]
        text = " ".join(word(lang) for _ in range(int(rng.integers(15, 60))))
        if i % 20 == 3:
            text = f"{text} {item} {text[:40]}"
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    rows += [(300 + i, rows[i][1], rows[i][2], "s0", 0) for i in range(0, 60, 3)]
    rows += [(400, "1234 5678", "aa", "s1", 9), (401, None, "bb", "s1", 0), (402, "", None, None, 0), (None, rows[0][1] + " xx", None, None, 0), (5, rows[5][1], "bb", "s1", 0)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOC).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, item


def stage(spark, name, docs, d):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, d)


AWKWARD = "size text_crc32 _id id times key kept kept_key shard slot row tie crc at lang_pred score _copy copy hot source_g h item_id n fp component_id".split()


def test_columns_of_any_name(spark, table):
    """No stage minds other columns; all but the last give them back, the last replaces shard and slot."""
    d, _, _ = table
    docs = spark.read.parquet(f"{d}/documents.parquet")
    wide = docs.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in AWKWARD], "map('a', doc_id) AS m", "1.5D AS `a.b`")
    for name, fn in corpus_pipeline.STAGES:
        plain, out = fn(spark, docs, d), fn(spark, wide, d)
        if name == "sharding":
            assert sorted(out.columns) == sorted(wide.columns)
            plain = plain.select(*docs.columns, "shard", "slot")
        else:
            assert out.columns == wide.columns and out.filter("size <> concat('size', doc_id)").count() == 0
        assert Counter(map(tuple, out.select(*plain.columns).collect())) == Counter(map(tuple, plain.collect()))


def test_empty_documents(spark, table, tmp_path):
    d, _, _ = table
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, fn in corpus_pipeline.STAGES:
        assert fn(spark, empty, d).count() == 0
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{d}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"shard", "slot"} <= set(out.columns)


def test_mixing_rows_without_id(spark, table):
    """Rows that share doc_id and text are taken by their own source's plan, and equal rows alike."""
    d, _, _ = table
    rows = [(None, "one two", "x", "aa", 0), (None, "one two", "x", "bb", 0), (None, "one two", "x", "bb", 0), (7, "three four", "x", "cc", 0)]
    rows += [(k, f"word{k} " * 50, "x", "dd", 0) for k in range(40)]
    docs = spark.createDataFrame(rows, DOC)
    plan = {r["source_g"]: r for r in mixing.plan(docs.select("doc_id", "text", "source")).collect()}
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(docs).filter("source = 'dd'").collect()}
    got = Counter((r.doc_id, r.source) for r in stage(spark, "mixing sources", docs, d).collect())
    assert plan["aa"].copies == plan["bb"].copies == plan["cc"].copies == 3
    assert got == Counter({(None, "aa"): 3, (None, "bb"): 6, (7, "cc"): 3} | {(k, "dd"): int(n) for k, n in taken.items() if n})
    assert got == Counter((r.doc_id, r.source) for r in stage(spark, "mixing sources", docs.repartition(3), d).collect())


def test_ties_of_near_duplicates(spark, table):
    """Of rows with one doc_id and text the same one stays on every run, and equal rows are one."""
    d, _, _ = table
    same = [(1, "a b c d e f", "x", s, 0) for s in ("p", "q", "q", None)] + [(2, "a b c d e f", "x", "s", 0)]
    kept = [[tuple(r) for r in stage(spark, "SimHash near-dedup", spark.createDataFrame(same[::-1] if k == 2 else same, DOC).repartition(k), d).collect()] for k in (1, 2, 5)]
    assert [len(x) for x in kept] == [1, 1, 1] and len({x[0] for x in kept}) == 1 and kept[0][0][:2] == (1, "a b c d e f")
    every = [tuple(r) for r in stage(spark, "SimHash near-dedup", spark.createDataFrame([*same, (1, "a b c d e g", "x", "r", 0)], DOC), d).collect()]
    assert every and len(every) == len(set(every)) and len({r[0] for r in every}) == len(every)


def test_places_do_not_depend_on_the_input_order(spark, table):
    """Rows that agree in doc_id and text but not in other columns get the same places on every run."""
    d, _, _ = table
    rows = [(k // 7, "same text", None, f"s{k % 7}", k) for k in range(140)]
    runs = [sorted(map(str, stage(spark, "sharding", spark.createDataFrame(rows[::-1] if k == 2 else rows, DOC).repartition(k), d).collect())) for k in (1, 2, 6)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 140


def test_stages(spark, table):
    d, rows, item = table
    docs = spark.read.parquet(f"{d}/documents.parquet")
    known = stage(spark, "language ID", docs, d)
    assert known.columns == docs.columns
    has_letters = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert Counter(map(tuple, known.collect())) == Counter(has_letters)

    named = [r for r in has_letters if r[0] is not None]
    prints = [slow_fingerprint(r[1]) for r in named]
    group = list(range(len(named)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if group[j] > group[i] and (a ^ b).bit_count() <= 4:
                    group[j], changed = group[i], True
    first = {}
    for g, r in zip(group, named):
        first[g] = min(first.get(g, r[0]), r[0])
    unique = stage(spark, "SimHash near-dedup", known, d)
    assert sorted(r.doc_id for r in unique.collect() if r.doc_id is not None) == sorted(first.values()) and unique.filter("doc_id is null").count() == 1

    clean = stage(spark, "benchmark decontamination", unique, d)
    kept = {r[0] for r in rows if r[0] is not None and item not in (r[1] or "")}
    assert {r.doc_id for r in clean.collect() if r.doc_id is not None} == set(first.values()) & kept

    mixed = stage(spark, "mixing sources", clean, d)
    times = Counter(r.doc_id for r in mixed.collect())
    size = {r.doc_id: (r.source, len((r.text or "").split())) for r in clean.collect()}
    assert set(times) <= set(size) and max(times.values()) <= 3 and mixed.columns == docs.columns
    total, by = sum(n for _, n in size.values()), Counter()
    for s, n in size.values():
        by[s] += n
    names = sorted(x for x in by if x is not None) + [None] * (None in by)
    weight = {n: 1 + k % 3 for k, n in enumerate(names)}
    capped = set()
    while True:
        level = (total - sum(3 * by[n] for n in capped)) / sum(weight[n] for n in names if n not in capped)
        new = {n for n in names if weight[n] * level > 3 * by[n]}
        if new <= capped:
            break
        capped |= new
    for n in names:
        target = 3 * by[n] if n in capped | new else weight[n] * level
        taken = sum(times[k] * m for k, (s, m) in size.items() if s == n)
        assert abs(taken - target) <= max(m for s, m in size.values() if s == n)

    out = stage(spark, "sharding", mixed, d)
    rows_out = out.collect()
    counts = Counter(r.shard for r in rows_out)
    assert len(rows_out) == sum(times.values()) and max(counts.values()) - min(counts.get(k, 0) for k in range(40)) <= 1
    assert all(sorted(r.slot for r in rows_out if r.shard == k) == list(range(n)) for k, n in counts.items())
    whole = corpus_pipeline.run(spark, d)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, rows_out))
