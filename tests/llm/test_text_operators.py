"""The operators against brute force on small tables with the awkward cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from semforge.llm import decontamination, langid, licenses, media, mixing, sharding, simhash, substring_dedup, suffix_dedup, superwindows
from semforge.llm.common import merge_spans, word_bounds

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{chr(97 + i % 26)}{i}é"[: 2 + i % 5] + str(i % 7) for i in range(60)]


def passage(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n).tolist())


@pytest.fixture(scope="module")
def docs(spark):
    p = [passage(k, 40) for k in range(8)]
    texts = {
        1: p[0], 2: p[0], 3: f"{p[1]}\n{p[0]} tail", 4: None, 5: "", 6: "   \t\n", 7: "short text", 8: "short text", 9: " ".join(p[:4]), 10: f"{p[2]}  {p[3]}\t{p[4]}",
        11: p[5] + " " + p[5], 12: "x" * 60, 13: "x" * 49, 14: "y" + "x" * 55, 15: " ".join([passage(99, 3000), p[6]]), 16: p[6], 17: "été " * 30, 18: "été " * 31, 19: p[7][:-8] + "changed",
        20: p[7], 21: "ab " * 200, 22: "zz " + "ab " * 100,
    }
    rows = [(k, t, "en", f"s{k % 3}" if k % 5 else None, 0) for k, t in texts.items()]
    rows += [(20, p[7], "en", "s1", 0), (20, p[0], "en", "s1", 0), (None, p[0], None, None, None), (None, p[0], None, None, None)]
    return spark.createDataFrame(rows, DOC).repartition(3)


def brute_removed(rows, window, cut):
    """Which units go, row by row; rows without an id neither give nor lose."""
    first = {}
    for d, t in rows:
        if d is not None:
            u = cut(t)
            for i in range(len(u) - window + 1):
                w = tuple(u[i : i + window])
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        u = cut(t)
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - window + 1) if d is not None else ():
            if first[tuple(u[i : i + window])] < d:
                gone[i : i + window] = True
        out.append((d, u, gone))
    return out


@pytest.mark.parametrize("hot", [2, 1 << 14])
def test_substring_dedup(docs, hot):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter()
    for d, u, gone in brute_removed(rows, 13, lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())):
        want[d, len(u), int(gone.sum()), hashlib.sha256(b" ".join(w for w, g in zip(u, gone) if not g)).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs.selectExpr("*", "1 AS spans", "2 AS key", "3 AS runs", "4 AS id"), hot_runs=hot).collect())
    assert got == want


@pytest.mark.parametrize("hot", [2, 1 << 14])
def test_suffix_dedup(docs, hot):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter()
    for d, u, gone in brute_removed(rows, 50, lambda t: (t or "").encode()):
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want[d, len(u), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(u, gone) if not g)).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs.selectExpr("*", "1 AS spans", "2 AS key", "3 AS runs", "4 AS id"), hot_runs=hot).collect())
    assert got == want


def test_repeats_over_several_chunks(spark):
    """Texts of several MB, a line in every document, and more than one task."""
    rng = np.random.default_rng(12)
    line = "a line that every single document of this table has " + passage(77, 12)
    long = " ".join(rng.choice(WORDS, 400_000).tolist())
    rows = [(k, f"{passage(100 + k, 30)} {line} {passage(500 + k, 30)}") for k in range(300)] + [(300, long), (301, passage(600, 5) + long[700_000:900_000] + line), (-1, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for hot in (50, 1 << 14):
        want = Counter((d, int(g.sum())) for d, _, g in brute_removed(rows, 13, lambda t: t.split()))
        assert Counter((r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(docs, hot_runs=hot).collect()) == want
        want = Counter((d, int(g.sum())) for d, _, g in brute_removed([(d, t) for d, t in rows if d < 300], 50, str.encode))
        assert Counter((r.doc_id, r.n_removed) for r in suffix_dedup.suffix_dedup(docs.filter("doc_id < 300"), hot_runs=hot).collect()) == want


@pytest.mark.parametrize("words", [False, True])
def test_hot_minimisers_are_dealt_out(words):
    """However many documents have a line, the largest bucket gets about as much as the others once its minimisers are known to be hot."""
    shape = superwindows.Shape(13, 5, True) if words else superwindows.Shape(50, 24, False)
    line = passage(77, 16)
    parts, largest = 32, {}
    for n in (400, 1600):
        texts = [f"{passage(10 + k, 20)} {line} {passage(100_000 + k, 20)}" for k in range(n)]
        ids = np.arange(n)
        keys, counts = np.unique(np.concatenate([superwindows.cut(pa.chunked_array([pa.array([t])]), shape).key for t in texts]), return_counts=True)
        hot_keys = keys[counts > n // 2] >> np.uint64(20)
        assert len(hot_keys)
        for hot in (None, superwindows._Hot.of(hot_keys)):
            sender = superwindows._Sender(shape, parts, hot)
            for a in range(0, n, 100):
                part = texts[a : a + 100]
                runs = [superwindows.cut(pa.chunked_array([pa.array([t])]), shape) for t in part]
                near = [np.flatnonzero(np.isin(r.key, keys[counts > n // 2])).astype("<u4").tobytes() for r in runs]
                sender.add(ids[a : a + 100], ids[a : a + 100], pa.chunked_array([pa.array(part)]), near)
            found = list(sender.flush())
            sizes = np.bincount([p for p, _ in found], [len(superwindows._opened(x)[5]) for _, x in found], parts)
            largest[n, hot is not None] = sizes.max() / sizes.sum()
    assert largest[1600, True] < 0.15 and largest[1600, True] < largest[1600, False] / 2


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOC)
    bench = spark.createDataFrame([], "item_id long, text string")
    for frame in (substring_dedup.substring_dedup(empty), suffix_dedup.suffix_dedup(empty), simhash.near_duplicates(empty), mixing.mix(empty), sharding.shard_documents(empty), langid.predict_documents(empty), decontamination.leaked_documents(empty, bench), licenses.scan_licenses(empty)):
        assert frame.count() == 0


def test_other_columns_play_no_part(docs):
    """Columns with names that the operators use themselves change no result."""
    names = "size text_crc32 id times key kept shard slot row tie crc at lang_pred score held_out h fp component_id label media feature n_bytes runs spans".split()
    wide = docs.selectExpr("*", *[f"'{c}' AS {c}" for c in names])
    for operator in (licenses.scan_licenses, mixing.mix, langid.predict_documents, media.media_columns, simhash.near_duplicates, sharding.shard_documents):
        assert Counter(map(str, operator(wide).collect())) == Counter(map(str, operator(docs).collect())), operator


@pytest.mark.parametrize("depth", [2, 3, 5, 9, 50])
def test_suffix_order(depth):
    rng = np.random.default_rng(depth)
    for _ in range(60):
        s = rng.integers(1, rng.integers(2, 5), rng.integers(1, 70)).astype(np.int64)
        order = suffix_dedup.suffix_order(s, depth)
        keys = [tuple(s[i : i + depth]) for i in order]
        assert sorted(order.tolist()) == list(range(len(s))) and keys == sorted(keys)


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_simhash(docs):
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    group = list(range(len(rows)))
    for _ in rows:
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if (a ^ b).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for g, (d, _) in zip(group, rows):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    want = Counter((d, f"{f:016x}", least.get(g)) for g, (d, f) in zip(group, rows))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want


def test_xxh64_lengths():
    data = np.random.default_rng(1).integers(0, 256, 4000).astype(np.uint8)
    starts = np.arange(200)
    lengths = np.arange(200)
    got = simhash.xxh64(data, starts, lengths)
    assert all(int(h) == xxhash.xxh64_intdigest(data[s : s + n].tobytes(), 42) for h, s, n in zip(got, starts, lengths))


def test_links_are_complete(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [int(b) for b in base] + [int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(1, 7), replace=False)) for b in base for _ in range(4)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    assert all(((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= 4 for e in edges)

    def roots(pairs):
        up = {f: f for f in fps}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[max(top(a), top(b))] = min(top(a), top(b))
        return {f: top(f) for f in fps}

    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 4]
    assert roots((e.a & (1 << 64) - 1, e.b & (1 << 64) - 1) for e in edges) == roots(near)


def test_components_of_a_chain(spark):
    edges = spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    nodes = spark.range(51).select("id", (100 - F.col("id")).alias("label"))
    out = simhash.components(nodes, edges)[0].collect()
    assert len(out) == 51 and {r.label for r in out} == {50}


def test_feistel_permutes():
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(sharding.permute(np.arange(n), n).tolist()) == list(range(n))


def test_sharding(docs):
    out = sharding.shard_documents(docs)
    rows = out.collect()
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.get(k, 0) for k in range(40)) <= 1 and len(rows) == docs.count()
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    again = Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.shard_documents(docs.repartition(7)).collect())
    assert Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in rows if r.doc_id is not None) == Counter({k: v for k, v in again.items() if k[0] is not None})


def test_mixing(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))), "en", f"s{i % 4}" if i % 9 else None, 0) for i in range(3000)] + [(9000, None, "en", "s0", 0), (9001, "a b c", "en", "tiny", 0), (5, " ".join(["w"] * 4), "en", "s1", 0)]
    out = mixing.mix(spark.createDataFrame(rows, DOC)).toPandas()
    assert len(out) == len(rows) and (out.taken <= 3 * out["size"]).all()
    sizes = out.groupby("source", dropna=False)["size"].sum()
    names = sorted(x for x in sizes.index if x == x and x is not None) + [None]
    size = {n: float(out[out.source.isna() if n is None else out.source == n]["size"].sum()) for n in names}
    weight = {n: 1 + k % 3 for k, n in enumerate(names)}
    target, capped = {}, set()
    while True:
        level = (sum(size.values()) - sum(3 * size[n] for n in capped)) / sum(weight[n] for n in names if n not in capped)
        new = {n for n in names if weight[n] * level > 3 * size[n]}
        if new <= capped:
            break
        capped |= new
    for n in names:
        target[n] = 3 * size[n] if n in capped else weight[n] * level
        own = out[out.source.isna() if n is None else out.source == n]
        assert abs(own.target.iloc[0] - target[n]) < 1e-6 and own.source_size.iloc[0] == size[n]
        assert abs(own.taken.sum() - target[n]) <= max(30, own["size"].max())
    again = mixing.mix(spark.createDataFrame(rows, DOC).repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert out[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


def test_language_id(spark):
    rng = np.random.default_rng(5)
    parts = {"aa": ["ka", "to", "mi", "ra"], "bb": ["ßen", "ung", "ich", "zu"]}
    rows = [(i, " ".join("".join(rng.choice(parts[x], 3)) for _ in range(int(rng.integers(3, 40)))), x, "s", 0) for i in range(600) for x in [["aa", "bb"][i % 2]]]
    rows += [(700, None, "aa", "s", 0), (701, "123 — !", "bb", "s", 0), (702, "", None, None, None), (None, "katomi", None, None, None)]
    out = {r.doc_id: r for r in langid.predict_documents(spark.createDataFrame(rows, DOC)).collect()}
    held = [r for r in rows if r[0] is not None and r[0] < 600 and out[r[0]].held_out]
    assert len(held) > 100 and np.mean([out[r[0]].lang_pred == r[2] for r in held]) > 0.98
    assert [out[k].lang_pred for k in (700, 701, 702)] == ["und"] * 3 and out[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in out.values())


def test_licenses_against_brute_force(spark):
    notice = licenses.TEMPLATES["MIT"][2]
    texts = {1: "Released under the MIT License.", 2: "Some prose.\nLicensed under the Apache License, Version 2.0.\nMore prose.", 3: "Nothing is licensed here at all, friends.", 4: None, 5: "", 6: notice.upper(), 7: f"Intro words\n\n{notice}\n\nbody", 8: "This work is licensed under the GNU General Public License, version 3.\n" * 3, 9: "MIT License"}
    got = {(r.doc_id, r.license_id): r for r in licenses.scan_licenses(spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")).collect()}
    want = {}
    for k, t in texts.items():
        words = licenses.normalised(t or "")
        hits = []
        # All windows of short texts; of long ones the whole.
        for i, j in [(i, j) for i in range(len(words)) for j in range(i + 2, len(words) + 1)] if len(words) < 40 else [(0, len(words))]:
            own = licenses.bigrams(words[i:j])
            for name, group in licenses.TEMPLATES.items():
                for template in map(licenses.bigrams, map(licenses.normalised, group)):
                    if (d := licenses.dice(own, template)) >= licenses.THRESHOLD and licenses.versions(template) <= set(own):
                        hits.append((-(own & template).total(), -d, i, name, j))
        taken = []
        for _, d, i, name, j in sorted(hits):
            if all(j <= x or y <= i or other == name for x, y, other in taken):
                taken.append((i, j, name))
                want[k, name] = max(want.get((k, name), 0), -d)
    short = {k for k, t in texts.items() if len(licenses.normalised(t or "")) < 40}
    assert {x: pytest.approx(v) for x, v in want.items() if x[0] in short} == {x: r.dice for x, r in got.items() if x[0] in short}
    assert all(got[x].dice >= v - 1e-9 for x, v in want.items())
    assert got[8, "GPL-3.0"].n_units == 3


def test_licenses_in_any_layout():
    """Notices in several paragraphs, wrapped, with CRLF or comment signs, or within a line, in documents that are much longer."""
    prose = " ".join(f"word{i % 37} other{i % 11}" for i in range(400))
    texts, names = [], []
    for name, group in licenses.TEMPLATES.items():
        for notice in group:
            w = notice.split()
            lines = [" ".join(w[i : i + 9]) for i in range(0, len(w), 9)]
            for layout in (notice, "\n".join(lines), "\n\n".join(lines), "\r\n\r\n".join(lines), "\n#\n".join("# " + x for x in lines)):
                texts += [f"{prose} {layout} {prose}", f"{prose}\n{layout}\n{prose}"]
                names += [name] * 2
    scanner = licenses.Scanner()
    found = {(row, name): (d, n) for row, name, d, n in scanner.scan(pa.chunked_array([pa.array([*texts, prose])]))}
    assert all((k, name) in found for k, name in enumerate(names)) and not any(k == len(texts) for k, _ in found)
    assert all(found[k, name][1] == 1 for k, name in enumerate(names))
    apart = licenses.TEMPLATES["MIT"][0].split()
    halves = [" ".join(apart[:2]), " ".join(apart[2:])]
    assert not scanner.scan(pa.chunked_array([pa.array(halves)]))


def test_each_licence_reports_itself_only():
    """Every notice, opening and identifier is its own licence's and no other's; other versions are nobody's."""
    scanner = licenses.Scanner()

    def names(*texts):
        return [(r, n) for r, n, _, _ in scanner.scan(pa.chunked_array([pa.array(texts)]))]

    every = [(name, t) for name, group in licenses.TEMPLATES.items() for t in group]
    assert names(*(t for _, t in every)) == [(k, name) for k, (name, _) in enumerate(every)] and len(licenses.TEMPLATES) == 24
    gpl2 = next(t for t in licenses.TEMPLATES["GPL-2.0"] if "either version" in t)
    apache = licenses.TEMPLATES["Apache-2.0"][1]
    others = ["Licensed under the Apache License, Version 1.1.", apache.replace("2.0", "1.1"), "Licensed under CC BY-NC 3.0.", gpl2.replace("version 2", "version 1"), "SPDX-License-Identifier: Artistic-2.0"]
    assert names(*others) == []
    # An edit in the longer licence doesn't make it the shorter one, and two licences side by side are two.
    three = licenses.TEMPLATES["BSD-3-Clause"][1].replace("holder nor", "owner nor").replace("retain", "keep")
    assert names(three, f"{apache} {gpl2}", "// SPDX-License-Identifier: MIT\nint main() {}", "Licensed under CC BY-NC-SA 4.0.") == [(0, "BSD-3-Clause"), (1, "Apache-2.0"), (1, "GPL-2.0"), (2, "MIT"), (3, "CC-BY-NC-SA-4.0")]


def test_language_of_many_labels_and_rare_letters(spark):
    """Six hundred labels, most of them dirt; letters beyond the second plane are letters."""
    rng = np.random.default_rng(3)
    kinds = {"aa": list("abcde"), "bb": list("vwxyz"), "cc": [chr(0x20000 + k) for k in range(40)], "dd": [chr(0x30000 + k) for k in range(40)]}
    rows = []
    for i in range(2400):
        name = list(kinds)[i % 4]
        text = " ".join("".join(rng.choice(kinds[name], 5)) for _ in range(12))
        rows.append((i, text, name if i % 3 else f"{name}-{i % 600}", "s", 0))
    rows += [(5000, "\U00020000\U00020001", None, None, 0), (5001, "12 \u3000", "aa", None, 0), (5002, None, "aa", None, 0)]
    got = {r.doc_id: r for r in langid.predict_documents(spark.createDataFrame(rows, DOC)).collect()}
    assert got[5001].lang_pred == got[5002].lang_pred == "und" and got[5000].lang_pred.startswith("cc") and got[5000].score > 0
    held = [r for r in rows if got[r[0]].held_out and r[0] < 5000]
    assert np.mean([got[r[0]].lang_pred[:2] == r[2][:2] for r in held]) > 0.99


def test_labels_beyond_the_bound_change_nothing(spark, monkeypatch):
    """The labels with the most rows are learnt; any number of rarer ones neither grows the matrix nor changes a prediction."""
    rng = np.random.default_rng(4)
    kinds = {"aa": list("abcdefg"), "bb": list("defghij")}
    rows = [(i, " ".join("".join(rng.choice(kinds[n], 4)) for _ in range(6)), n, "s", 0) for i in range(600) for n in [list(kinds)[i % 2]]]
    dirt = [(10_000 + i, "zzz yyy", f"dirt-{i}", "s", 0) for i in range(3000)]
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    clean, dirty = ({r.doc_id: (r.lang_pred, r.score) for r in langid.predict_documents(spark.createDataFrame(x, DOC)).collect()} for x in (rows, rows + dirt))
    assert all(dirty[k] == v for k, v in clean.items())
    model = langid.fit(spark.createDataFrame(rows + dirt, DOC))
    assert model.languages == ("aa", "bb") and model.log_prob.shape == (langid.BUCKETS, 2)


def test_words_and_spans():
    texts = pa.chunked_array([pa.array(["ab c", None, "", " d\n", "e"])])
    from semforge.llm.common import flat_bytes

    data, offsets = flat_bytes(texts)
    starts, ends, rows = word_bounds(data, offsets)
    assert [(bytes(data[s:e]), int(r)) for s, e, r in zip(starts, ends, rows)] == [(b"ab", 0), (b"c", 0), (b"d", 3), (b"e", 4)]
    s, e = merge_spans(np.array([5, 0, 2, 9]), np.array([7, 2, 4, 10]))
    assert s.tolist() == [0, 5, 9] and e.tolist() == [4, 7, 10]
