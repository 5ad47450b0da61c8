import hashlib
import random

import pytest

from rasterloom.llm import suffixes


def brute(texts, length):
    places = {}
    data = [(t or "").encode() for t in texts]
    for i, d in enumerate(data):
        for s in range(len(d) - length + 1):
            places.setdefault(d[s : s + length], []).append((i, s))
    gone = [set() for _ in data]
    for found in places.values():
        if len(found) > 1:
            for i, s in found:
                gone[i].update(range(s, s + length))
    out = []
    for d, g in zip(data, gone, strict=True):
        spans = sum(1 for p in g if p - 1 not in g)
        out.append((len(d), len(g), spans, hashlib.sha256(bytes(b for p, b in enumerate(d) if p not in g)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(rng.randint(10, 40))) for _ in range(6)]
    texts = [None, "", "ab", "a" * 300, "ab" * 200, "xyz " * 90, "0" * 41]
    for _ in range(60):
        t = ""
        for _ in range(rng.randint(1, 6)):
            s = rng.choice(shared)
            cut = rng.randint(0, len(s))
            t += rng.choice([s, s[cut:], s[:cut], word() + " " + word(), " ".join(word() for _ in range(30))]) + rng.choice([" ", "", "\n"])
        texts.append(t)
    return texts + texts[10:14] + [texts[20][:-1], texts[21] + "!"]


@pytest.mark.parametrize("seed,batches,chunk,crowded,bits", [(1, 1, 1 << 19, 4096, 1 << 28), (2, 4, 1 << 19, 3, 1 << 28), (3, 3, 64, 4096, 1 << 28), (4, 2, 64, 1, 1 << 28), (5, 2, 1 << 19, 4096, 1)])
def test_against_brute_force(spark, monkeypatch, seed, batches, chunk, crowded, bits):
    """bits: with few, the filter lets most entries through."""
    monkeypatch.setattr(suffixes, "MOST_FILTER_BITS", bits)
    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    texts = corpus(seed)
    rows = [(i if i else None, t, "clash", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, key int").repartition(3)
    got = suffixes.remove_repeats(df, length=40, key=20, batches=batches, texts=True).collect()
    wanted = brute(texts, 40)
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == wanted[r.doc_id or 0], texts[r.doc_id or 0]
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_no_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "x" * 399), (2, "short")], "doc_id long, text string")
    assert [r.n_removed for r in suffixes.remove_repeats(df).collect()] == [0, 0]
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_clean_texts_keeps_other_columns(spark):
    same = "é" * 300
    df = spark.createDataFrame([(1, "a" + same, "en", "__x"), (2, same + "b", "fr", None), (3, None, None, None), (3, "keep", "de", "")], "doc_id long, text string, lang string, spans string")
    out = suffixes.clean_texts(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text or "-", r.lang or "") for r in out.collect()) == [(1, "a", "en"), (2, "b", "fr"), (3, "-", ""), (3, "keep", "de")]


def test_family_levels_are_geometric(spark):
    family = suffixes.SuffixFamily(spark)
    for i in range(5):
        family.add(spark.createDataFrame([(i, i, 1), (9, i % 2, 1)], "key long, whole long, n int"))
    assert sorted(family.levels) == [0, 2]
    twice, alone = family.matches()
    assert sorted((r.key, r.whole) for r in twice.collect()) == [(9, 0), (9, 1)]
    assert alone.count() == 0


def test_family_lasts(spark, tmp_path):
    """A batch added later, by a family that knows only the folder, gives what one run over all gives."""
    texts = corpus(6)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()
    options = dict(length=40, key=20, batches=2, passages=True)
    once = {r.doc_id: tuple(r) for r in suffixes.remove_repeats(df, **options).collect()}
    for names in (["1", "2", "3"], ["3"]):  # the second time everything is there
        for k, name in enumerate(names, 4 - len(names)):
            upto = df.where(f"doc_id % 3 < {k}")
            new = df.where(f"doc_id % 3 = {k - 1}")
            got = {r.doc_id: tuple(r) for r in suffixes.remove_repeats(upto, lasting=suffixes.Lasting(str(tmp_path), name, new), **options).collect()}
            known = [texts[i] if i in got else None for i in range(len(texts))]
            assert {i: r[1:5] for i, r in got.items()} == {i: w for i, w in enumerate(brute(known, 40)) if i in got}
        assert got == once
    state = suffixes.SuffixFamily(spark, f"{tmp_path}/bytes", (40, 20))
    assert len(state.names) == 6 and sorted(state.levels) == [1, 2]
    kept = {p.name for p in (tmp_path / "bytes").iterdir()}
    assert kept == {"state"} | {p.rsplit("/", 1)[1] for p in [*state.levels.values(), *state.found]}
    with pytest.raises(ValueError):
        suffixes.SuffixFamily(spark, f"{tmp_path}/bytes", (41, 20))


def test_covering_entries_leave_nothing_out():
    rng = random.Random(7)
    text = lambda n: bytes(rng.choices(b"abcdefgh", k=n))
    s = suffixes.Stretch([(i, 0, text(rng.randint(40, 900))) for i in range(12)], 40, 20)
    covered = lambda spans: {(t, x) for t, f, e in spans for x in range(f, e)}
    span = lambda i: (int(s.text[i]), int(s.first[i]), int(s.last[i]) + 40)
    for share in (1, 0.9, 0.5, 0):
        found = suffixes.np.array([i for i in range(len(s.first)) if rng.random() < share], int)
        chosen, between = suffixes._covering(s, found)
        assert covered(map(span, chosen)) == covered(map(span, found)) and len(chosen) == len(between)
        for wrong in [{int(c) for c in chosen if rng.random() < p} for p in (0.1, 0.5)]:
            right = [i for i in found.tolist() if i not in wrong]
            spans = [span(i) for i in chosen.tolist() if i not in wrong]
            places = {(int(s.key[i].view("i8")), int(s.whole[i].view("i8"))) for i in right}
            for i, near in zip(chosen.tolist(), between, strict=True):
                if i in wrong and near:
                    for r in suffixes.np.frombuffer(near, suffixes._BETWEEN):
                        if (int(r["key"]), int(r["whole"])) in places:
                            spans.append((int(s.text[i]), int(s.first[i]) + int(r["first"]), int(s.first[i]) + int(r["last"]) + 40))
            assert covered(spans) == covered(map(span, right))


@pytest.mark.parametrize("seed,crowded,bits", [(1, 4096, 1 << 28), (2, 1, 1 << 28), (3, 4096, 1)])
def test_passages_of_over_fifty_words(spark, monkeypatch, seed, crowded, bits):
    """Short words, so that bytes alone don't find them; those of 50 words stay."""
    import re

    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    monkeypatch.setattr(suffixes, "MOST_FILTER_BITS", bits)
    rng = random.Random(seed)
    prose = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(n))
    passages = [prose(n) for n in (51, 51, 50, 60, 45)]
    texts = [None, "", prose(51)]
    for _ in range(30):
        p = rng.choice(passages)
        texts.append(prose(rng.randint(0, 60)) + rng.choice([" ", "\n"]) + rng.choice([p, p, p.replace(" ", "\n", 3)]) + " " + prose(rng.randint(0, 60)))
    words = [[m.group() for m in re.finditer(rb"\S+", (t or "").encode())] for t in texts]
    seen = {}
    for i, w in enumerate(words):
        for at in range(len(w) - 50):
            seen.setdefault(tuple(w[at : at + 51]), []).append((i, at))
    gone = {(i, at + k) for found in seen.values() if len(found) > 1 for i, at in found for k in range(51)}
    left = {i: [x for k, x in enumerate(w) if (i, k) not in gone] for i, w in enumerate(words)}
    assert gone and any(passages[2].split()[7].encode() in w for w in left.values())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in suffixes.clean_texts(df, by_words=True).collect()}
    assert got[0] is None and {i: (t or "").encode().split() for i, t in got.items()} == left
    assert all(len(p.encode()) < suffixes.LENGTH for p in passages)
    told = {r.doc_id: (r.n_removed, r.n_passage_words) for r in suffixes.remove_repeats(df, passages=True).collect()}
    assert told == {i: (0, sum((i, k) in gone for k in range(len(w)))) for i, w in enumerate(words)}
    stage = __import__("corpus_pipeline").suffix_stage(spark, df, "")
    assert {r.doc_id: (r.text or "").encode().split() for r in stage.collect()} == {i: w for i, w in left.items() if w or not texts[i]}


def test_passages_are_whole_documents(spark):
    text = " ".join(f"w{i}" for i in range(51))
    df = spark.createDataFrame([(1, text + "\n"), (2, "\t" + text), (3, " "), (4, text[:-3])], "doc_id long, text string")
    stage = __import__("corpus_pipeline").suffix_stage(spark, df, "")
    assert {r.doc_id: r.text for r in stage.collect()} == {3: " ", 4: text[:-3]}


def test_query_tells_passages_of_over_fifty_words(spark, tmp_path):
    """Those of under 400 bytes too, which stay as the contract removes strings of 400 bytes only."""
    from rasterloom.llm import queries

    passage, long = " ".join(f"w{i}" for i in range(60)), " ".join(f"word{i:04}" for i in range(60))
    texts = [f"a {passage} b", f"c\n{passage} d e", f"f {long} g", f"h {long} i", passage[:150], None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_suffix_dedup(spark, str(tmp_path))
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(passage) < suffixes.LENGTH and [tuple(rows[i])[1:5] for i in range(6)] == brute(texts, suffixes.LENGTH)
    assert [rows[i].n_removed > 0 for i in range(6)] == [False, False, True, True, False, False]
    assert [rows[i].n_passage_words for i in range(6)] == [60, 60, 60, 60, 0, 0]
