"""Benchmark decontamination against brute force and planted passages."""

import numpy as np
import pyarrow as pa
import pytest

from semforge.llm import decontamination

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LETTERS = list("abcdefghijklmnopqrstuvwxyz")
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to is st io le as ou ing ion ent her tha".split()


def slow_distance(a, b):
    """The least edits from a to any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edit_distance():
    rng = np.random.default_rng(2)
    for _ in range(100):
        a, b = ("".join(rng.choice(list("abé"), rng.integers(1, 14))) for _ in range(2))
        assert decontamination.distance(a, b, len(a))[0] == slow_distance(a, b)


def random_word(rng):
    return "".join(rng.choice(LETTERS, rng.integers(2, 10)))


def syllable_word(rng):
    return "".join(rng.choice(SYLLABLES, rng.integers(1, 4)))


def edited(rng, text, share, even):
    """``share`` of the characters replaced, preceded by another or left out; at random places or as evenly spread as can be."""
    n, e = len(text), int(share * len(text))
    at = ((np.arange(e) + rng.random()) * n / max(e, 1)).astype(int) if even else rng.choice(n, e, replace=False)
    out = list(text)
    for p in sorted(at.tolist(), reverse=True):
        other = LETTERS[rng.integers(26)]
        out[p : p + 1] = [[other], [], [other, out[p]]][rng.integers(3)]
    return "".join(out)


def found(items, texts):
    tables = decontamination.Tables([(k, 1, t) for k, t in enumerate(items)])
    return tables.matches(decontamination._Text(pa.chunked_array([pa.array(texts, pa.string())])))


@pytest.mark.parametrize("make", [random_word, syllable_word])
@pytest.mark.parametrize(("even", "least"), [(False, (1, 0.98, 0.98, 0.98, 0.97)), (True, (1, 0.98, 0.98, 0.96, 0.9))])
def test_recall(make, even, least):
    """Items of 6 to 80 words with 0, 5, 10, 15 and 19% edits, at any phase of words, in documents without other leaks."""
    rng = np.random.default_rng(21)

    def text(n):
        return " ".join(make(rng) for _ in range(n))

    caught, made = np.zeros(5), np.zeros(5)
    for words in (5, 6, 12, 20, 30, 80):
        before = caught.sum(), made.sum()
        items = [text(words) for _ in range(24)]
        for s, share in enumerate((0, 0.05, 0.1, 0.15, 0.19)):
            texts = [f"{text(rng.integers(3, 30))} {edited(rng, t, share, even)} {text(20)}" for t in items]
            got = {(r, i[0]): d for r, i, d, *_ in found(items, [*texts, *(text(60) for _ in range(20))])}
            assert all(d == decontamination.distance(items[k], texts[r], 10**6)[0] for (r, k), d in got.items())
            assert all(r == k for r, k in got) or words < 8
            for k, t in enumerate(items):
                most = int(0.2 * len(t) + 1e-9)
                if decontamination.distance(t, texts[k], most)[0] <= most:
                    made[s] += 1
                    caught[s] += (k, k) in got
        # No size hides behind the others.
        assert caught.sum() - before[0] >= 0.95 * (made.sum() - before[1]), words
    assert (caught >= np.array(least) * made).all(), (caught / made).tolist()


@pytest.mark.parametrize("words", [1, 2, 3, 4])
def test_recall_of_few_long_words(words):
    """Items of one to four words with letters replaced; exact copies are always found."""
    rng = np.random.default_rng(words)
    items = [" ".join("".join(rng.choice(LETTERS, 40 // words + 4)) for _ in range(words)) for _ in range(60)]
    for share, least in ((0, 1.0), (0.05, 0.95 if words > 2 else 0.7), (0.1, 0.9 if words > 2 else 0.5)):
        texts = [f"the text {edited(rng, t, share, False)} goes on" for t in items]
        got = {(r, i[0]) for r, i, *_ in found(items, texts)}
        assert all(r == k for r, k in got) and len(got) >= least * len(items)


def test_words_as_sequences():
    rng = np.random.default_rng(0)
    for _ in range(200):
        texts = ["".join(rng.choice(list("ab é東語\U00020000"), rng.integers(0, 12))) for _ in range(3)]
        data, offsets = decontamination.flat_bytes(pa.array(texts, pa.string()))
        starts, ends, rows = decontamination._tokens(data, offsets)
        got = [(int(r), data[a:b].tobytes().decode()) for a, b, r in zip(starts, ends, rows)]
        assert got == [(r, w) for r, t in enumerate(texts) for w in decontamination.re.findall(decontamination.WORD, t)]


def test_tables_are_built_once_for_a_share(monkeypatch):
    built, tables = [], decontamination.Tables
    monkeypatch.setattr(decontamination, "Tables", lambda items: built.append(items) or tables(items))
    monkeypatch.setattr(decontamination, "TEXT_BYTES", 100)

    class Block:
        def __init__(self, k):
            self.value = [(k, 1, f"one two three four five six item {k} here")]

    texts = [f"start one two three four five six item {k % 3} here and then the end of it" for k in range(30)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    found = [sorted(i[0] for _, i, *_ in out) for _, out in decontamination._searched(iter([batch]), [Block(k) for k in range(3)])]
    assert len(built) == 3 and sum(map(len, found)) >= 30


def test_leaks_and_what_stays(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(LETTERS[:16], rng.integers(3, 9))) for _ in range(400)]

    def text(n):
        return " ".join(rng.choice(words, n))

    items = [(k, text(int(rng.integers(12, 60)))) for k in range(30)]
    bench = [*items, (70, items[3][1].upper()), (71, items[3][1]), (None, items[4][1]), (90, "only four words here"), (91, None), (92, ""), (93, " \t"), (94, "Xyzzy")]
    rows, planted = [], {}
    for i in range(300):
        body = text(150)
        if i % 2:
            k, t = items[i % 30]
            w = t.split()
            for j in rng.choice(len(w), int(len(w) * (0, 0.05, 0.1)[i % 3]), replace=False):
                w[j] = w[j][::-1]
            leak = " ".join(w)
            if (d := decontamination.distance(t, leak, len(t))[0]) <= 0.2 * len(t):
                planted[i, k] = d
            body = f"{text(20)} {leak} {body}"
        rows.append((i, body, "en", "s", 0))
    rows += [(500, None, None, None, None), (501, "", "en", "s", 0), (502, "or only  FOUR\nwords here then", "en", "s", 0), (503, "only four word here", "en", "s", 0), (504, "the xyzzy", "en", "s", 0), (505, "xyzzys", "en", "s", 0)]
    rows += [(None, items[5][1], "en", "s", 0), (1, rows[1][1], "en", "s", 0)]
    docs, benchmark = spark.createDataFrame(rows, DOC).selectExpr("*", "1 AS item_id", "2 AS key", "3 AS distance"), spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "4 AS doc_id", "5 AS n")
    got = decontamination.leaked_documents(docs, benchmark).collect()
    have = {(r.doc_id, r.item_id): r for r in got}
    assert len(have) == len(got)
    expected = set(planted) | {(502, 90), (504, 94), (None, 5)}
    assert set(have) <= expected and {(502, 90), (504, 94), (None, 5)} <= set(have)
    assert len(set(have) & set(planted)) >= 0.99 * len(planted) and all(have[x].distance <= planted[x] for x in set(have) & set(planted))
    assert all(r.n_items == {3: 3, 4: 2}.get(r.item_id, 1) for r in got)
    classes = {r.item_id: r.class_id for r in decontamination.item_classes(benchmark).filter("item_id is not null").collect()}
    assert classes == {k: 3 if k in (70, 71) else None if k == 91 else k for k, _ in bench if k is not None}
    clean = decontamination.drop_leaked(docs, benchmark)
    gone = {d for d, k in have if k < 90}
    assert [r.doc_id for r in sorted(clean.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))] == [r[0] for r in rows if r[0] not in gone] and clean.columns == docs.columns
    assert {r.doc_id for r in decontamination.drop_leaked(docs, benchmark, 1).collect()} == {r[0] for r in rows} - gone - {502, 504}


def test_blocks_and_long_texts(spark, monkeypatch):
    """Blocks of the benchmark are searched in one pass or several alike; a text of several MB and one of many characters are whole."""
    rng = np.random.default_rng(4)
    items = [(k, " ".join(random_word(rng) for _ in range(30))) for k in range(12)] + [(20, "ключ замок дверь окно стена крыша"), (21, "多 語 の 文 字 列 で す")]
    long = " ".join(random_word(rng) for _ in range(300_000))
    rows = [(1, f"{long} {items[7][1]} {long[:1000]} {items[20 - 8][1]}"), (2, f"x {items[13][1]} y"), (3, long[:5000])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 7), (1, 20), (2, 21)}
    for size, blocks in ((1 << 20, 64), (400, 64), (400, 2)):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        monkeypatch.setattr(decontamination, "PASS_BLOCKS", blocks)
        assert {(r.doc_id, r.item_id) for r in decontamination.leaked_documents(docs, bench).collect()} == want
        assert {r.doc_id for r in decontamination.drop_leaked(docs, bench).collect()} == {3}


def test_scripts_without_blanks(spark):
    """Items and documents of one long word each, with characters replaced, are found as others are; a few characters only exactly."""
    rng = np.random.default_rng(9)
    kanji = [chr(0x4E00 + k) for k in range(600)]

    def text(n):
        return "".join(rng.choice(kanji, n))

    items = [(k, text(40)) for k in range(20)] + [(50, "東京都"), (51, "\U00020000\U00020001\U00020002\U00020003\U00020004\U00020005")]
    rows = []
    for k in range(20):
        out = list(items[k][1])
        for p in rng.choice(40, (0, 3, 6)[k % 3], replace=False):
            out[p] = kanji[rng.integers(600)]
        rows.append((k, text(30) + "".join(out) + text(25)))
    rows += [(100, text(300)), (101, "東京都 です"), (102, "東京都です"), (103, "x \U00020000\U00020001\U00020002\U00020003\U00020004\U00020005 y")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaked_documents(docs, bench).collect()}
    assert got <= {(k, k) for k in range(20)} | {(101, 50), (102, 50), (103, 51)} and len(got) >= 22 and {(101, 50), (102, 50)} <= got
    assert {r.doc_id for r in decontamination.drop_leaked(docs, bench).collect()} >= {100, 101, 102}


def test_empty(spark):
    docs, bench = spark.createDataFrame([], DOC), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontamination.leaked_documents(docs, some).count() == 0 and decontamination.drop_leaked(docs, some).count() == 0
    assert decontamination.drop_leaked(some.withColumnRenamed("item_id", "doc_id"), bench).count() == 1
