"""The dealt operators against brute force, and their edge cases."""

import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strainspark.llm import (chat_format, decontaminate, embedding_dedup, language_id, line_dedup, minhash_dedup, mixing, queries, secrets,
                             token_files, url_filter)

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k}" for k in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and a clashing extra column."""
    rows = [(1, "Die Katze. password = hunter22x", "de", "s1", 3), (2, None, "en", None, None), (3, "", None, "s1", 0), (None, "no id here at all", "en", "s2", 1),
            (5, "???", "fr", "s2", 3), (6, LONG, "en", "s1", 9), (7, LONG + " end", "en", "s1", 9), (8, "the cat sat on the mat", "en", "s3", 2), (8, "the cat sat on the mat", "en", "s3", 2), (9, "A\nB\nthe cat sat on the mat", "en", "s3", 2)]
    return spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("extra"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(ids, linked):
    above = {x: x for x in ids}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in linked:
        x, y = top(a), top(b)
        above[max(x, y)] = min(x, y)
    return {x: top(x) for x in ids}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, data, duck, same, name):
    same(queries.QUERIES[name](spark, data).toPandas(), duck.sql(queries.SQL[name]).df())


def documents(spark, data):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


# 1


def test_language_is_right_on_held_out_documents(spark, data):
    rows = queries.op1_language_id(spark, data).collect()
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_backs_off_and_handles_odd_rows(odd, empty):
    model = language_id.Model({"en": {"the": 5, "cat": 3}, "de": {"die": 5, "katze": 3}}, {"en": 1, "de": 1})
    scores = language_id._Scores(model)
    assert language_id.predict(model, scores, "katzen")[0] == "de"  # unseen word, by its character n-grams
    assert language_id.predict(model, scores, "日本")[0] in ("de", "en")
    got = [(r.doc_id, r.p) for r in odd.select("doc_id", language_id.identify(odd, model).alias("p")).collect()]
    assert len(got) == 10 and {k: p.lang_pred for k, p in got if k in (1, 2, 3, 5, 8)} == {1: "de", 2: "und", 3: "und", 5: "und", 8: "en"}
    assert language_id.predict(language_id.fit(empty), language_id._Scores(language_id.fit(empty)), "the") == ("und", 0.0)


def test_language_scores_are_those_of_a_plain_model():
    """The hashed tables against dictionaries of words and n-grams."""
    from collections import Counter
    from math import exp, log

    counts = {"en": {"the": 50, "cat": 3, "a": 7, "dog": 4}, "de": {"die": 40, "katze": 3, "a": 1, "hund": 2}}
    tables = [{x: Counter(counts[x]) for x in counts}]
    for n in range(1, language_id.LONGEST + 1):
        padded = lambda w: f"^{w}$" if n > 1 else w  # noqa: B023, E731
        tables.append({x: Counter() for x in counts})
        for x, one in counts.items():
            for w, c in one.items():
                for k in range(len(padded(w)) - n + 1):
                    tables[n][x][padded(w)[k : k + n]] += c

    def score(word, x):
        known = lambda table, key: any(key in one for one in table.values())
        rate = lambda table, key: log((table[x][key] + language_id.SMOOTHING) / (sum(table[x].values()) + language_id.SMOOTHING * (len({k for one in table.values() for k in one}) + 1)))
        if known(tables[0], word):
            return rate(tables[0], word)
        for n in range(language_id.LONGEST, 0, -1):
            w = f"^{word}$" if n > 1 else word
            found = [rate(tables[n], w[k : k + n]) for k in range(len(w) - n + 1) if known(tables[n], w[k : k + n])]
            if found:
                return sum(found) / len(found)
        return 0.0

    model = language_id.Model(counts, {"en": 3, "de": 1})
    for text in ("the cat", "die katzen", "hunde the dogs a", "x", "zq zz", "cathedral " * 30, "日本 the"):
        words = text.lower().split()
        total = {x: sum(score(w, x) for w in words) / len(words) * min(len(words), 20) + log({"en": 0.75, "de": 0.25}[x]) for x in counts}
        best = max(sorted(total), key=total.get)
        got = language_id.predict(model, language_id._Scores(model), text)
        assert got[0] == best and abs(got[1] - 1 / sum(exp(v - total[best]) for v in total.values())) < 1e-4, text


def test_signs_of_numbers_are_no_letters(spark):
    model = language_id.Model({"en": {"the": 5}, "de": {"die": 5}}, {"en": 1, "de": 1})
    assert language_id.tokens("½ ② Ⅷ x²y 3 Ünï") == ["x", "y", "ünï"]
    docs = spark.createDataFrame([(1, "½ ②"), (2, LONG)], "doc_id long, text string")
    got = {r.doc_id: r.p for r in docs.select("doc_id", language_id.identify(docs, model).alias("p")).collect()}
    assert tuple(got[1]) == ("und", 0.0) and got[2].lang_pred in ("en", "de")


# 2


def test_raking_meets_the_targets(spark, data):
    rows = mixing.with_probability(spark.read.parquet(f"{data}/documents.parquet")).select("mix.*").toPandas()
    rows["mass"] = rows.tokens * rows.probability
    for margin in mixing.MARGINS:
        natural = rows.groupby(margin).tokens.sum() ** mixing.TEMPERATURE
        assert abs(rows.groupby(margin).mass.sum() / rows.mass.sum() - natural / natural.sum()).max() < 1e-4
    assert rows.probability.max() == 1.0


def test_raking_goes_on_until_given_targets_are_met(spark):
    cells = [("a", "en", 990), ("a", "de", 10), ("b", "en", 10), ("b", "de", 990), ("c", "en", 5), ("c", "de", 995)]
    docs = spark.createDataFrame([(k, "w " * n, lang, source, n) for k, (source, lang, n) in enumerate(cells)], DOCS)
    given = {"source": [("a", 0.5), ("b", 0.25), ("c", 0.25)], "lang": [("en", 0.3), ("de", 0.7)]}
    out = mixing.with_probability(docs, {m: spark.createDataFrame(x, f"{m} string, share double") for m, x in given.items()}).select("mix.*").toPandas()
    out["mass"] = out.tokens * out.probability
    for margin, shares in given.items():
        got = out.groupby(margin).mass.sum() / out.mass.sum()
        assert all(abs(got[x] - share) < 1e-5 for x, share in shares)


def test_raking_warns_of_targets_that_no_weights_meet(spark):
    docs = spark.createDataFrame([(1, "w w", "en", "a", 2), (2, "w w", "de", "b", 2)], DOCS)
    given = {"source": [("a", 0.9), ("b", 0.1)], "lang": [("en", 0.1), ("de", 0.9)]}
    with pytest.warns(UserWarning, match="off its target"):
        assert mixing.with_probability(docs, {m: spark.createDataFrame(x, f"{m} string, share double") for m, x in given.items()}).count() == 2


def test_mixing_keeps_every_odd_row(odd, empty):
    out = mixing.with_probability(odd)
    assert out.count() == 10 and set(odd.columns) < set(out.columns)
    assert mixing.with_probability(empty).count() == 0


# 3


def test_snapshots_collapse(spark):
    turns = [("a", 0, "user", "hi"), ("a", 1, "assistant", "yo"), ("b", 0, "user", "hi"), ("c", 0, "user", "hi"), ("c", 1, "assistant", "yo"), ("d", 0, "user", "other"), ("d", 0, "user", "other"), ("e", None, None, None), (None, 0, "user", "x")]
    rows = spark.createDataFrame([({"a": 1, "b": 2, "c": 3, "d": 4, "e": 5, None: None}[k], t, r, x) for k, t, r, x in turns], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat_format.format_chats(rows).collect()}
    assert got[1] == (2, 2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n")
    assert set(got) == {1, 4, 5} and got[4][0] == 1
    assert chat_format.format_chats(rows.limit(0)).count() == 0


def test_long_conversations_are_rendered_in_pieces(spark):
    rows = spark.range(600).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    prefix = rows.filter("turn < 400").withColumn("conv_id", F.lit(2).cast("long"))
    got = chat_format.format_chats(rows.union(prefix)).orderBy("piece").collect()
    assert [(r.conv_id, r.piece) for r in got] == [(1, 0), (1, 1), (1, 2)]
    assert "".join(r.text for r in got) == "".join(f"<|im_start|>user\n{k}<|im_end|>\n" for k in range(600))


# 4


def test_token_files_give_the_library_s_ids(spark, data):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(TOKENIZER), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op4_token_files(spark, data).collect()}
    for doc_id, text in sorted(documents(spark, data).items()):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[doc_id] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_encoder_on_odd_texts():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(TOKENIZER), token_files.Encoder(TOKENIZER)
    for text in ("It's  Été—naïve ÀÖ×÷ß", "a<|endoftext|>b <|startoftext|>", "e\u0301 x\u0301y \u0301z", "1234 a1b2'll 's", "日本語 ΑΣ ΣΑΣ İi", "\x1c\x85\u2028x \xa0y", "'re'd", "ǅ ﬁ ½ ²"):
        ids = np.frombuffer(encoder.encode(text.encode()), encoder.dtype).tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_variable_length_round_trip():
    values = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    for n in range(len(values) + 1):
        control, data = token_files.pack(values[:n])
        assert (token_files.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == values[:n]).all()
    content = token_files.write_file(np.array([3, 2, 2]), [None, 7], np.array([1, 2]), 40, np.array([9, 9, 0, 1], np.uint32))
    doc_ids, lengths, start, ids = token_files.read_file(content, np.array([2, 3]))
    assert (doc_ids, lengths.tolist(), start, ids.tolist()) == ([None, 7], [1, 2], 40, [3, 2, 2])


def test_token_files_of_odd_rows(odd, empty):
    rows = token_files.round_trip(odd, TOKENIZER).collect()
    assert len(rows) == 10 and {r.doc_id: r.n_tokens for r in rows}[2] == 1 and rows[0].start in {r.start for r in rows}
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [None, 1, 2, 3, 5, 6, 7, 8, 8, 9]
    assert token_files.round_trip(empty, TOKENIZER).count() == 0


# 5


def windows(items):
    out = {}
    for item, text in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            out.setdefault(tuple(w[k : k + n]), set()).update([] if item is None else [str(item)])
    return out


def contaminated(text, found):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, items = set(), set()
    for n in {len(x) for x in found}:
        for k in range(len(w) - n + 1):
            if (own := found.get(tuple(w[k : k + n]))) is not None:
                hit |= set(range(k, k + n))
                items |= own
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def test_contamination_is_brute_force(spark, data):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    docs, found = documents(spark, data), windows(items)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op5_decontaminate(spark, data).collect()}
    assert got == {k: contaminated(t, found) for k, t in docs.items()}
    assert any(x[4] for x in got.values())


def test_contamination_of_short_items_in_several_blocks(spark, odd):
    items = [(1, "Cat sat"), (2, "the CAT sat on"), (3, None), (4, "?!"), (5, "mat"), (None, "cat"), (6, " ".join(f"word{k}" for k in range(5, 25)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = windows(items)
    for size in (8_000_000, 40):
        got = decontaminate.contamination(odd, bench, block_bytes=size, out="c")
        assert got.columns == [*odd.columns, "c"]
        got = got.select("doc_id", "text", "c").collect()
        assert len(got) == 10
        for r in got:
            n_words, n_hit, n_items, _, _ = contaminated(r.text, found)
            assert (r.c.n_words, sum(s["last"] - s["first"] for s in r.c.spans), len(r.c.item_ids)) == (n_words, n_hit, n_items)
    assert decontaminate.contamination(odd, bench.limit(0), out="c").filter("size(c.spans) > 0").count() == 0
    nameless = spark.createDataFrame([(None, "sat on the mat")], "item_id long, text string")
    hit = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.report(odd, nameless).collect()}
    assert hit[8] == hit[9] == (4, 0, True) and hit[1] == hit[2] == (0, 0, False)


def test_searches_find_all_windows():
    """Few words, so that blocks, prefixes and whole windows repeat; items of all lengths, repeated and nested."""
    rng = np.random.default_rng(3)
    text = lambda n, k: " ".join(f"w{x}" for x in rng.integers(k, size=n))
    for k in (2, 3, 6):
        items = [(str(i) if i % 5 else None, text(rng.integers(0, 25), k)) for i in range(30)]
        items.append((items[1][0] + "x", items[1][1]))
        found, finders = windows(items), decontaminate.searchers([(i, t.encode()) for i, t in items], 10)
        for _ in range(40):
            doc = text(rng.integers(0, 60), k + 1)
            words, spans, here = decontaminate.words_of(doc.encode()), [], set()
            for finder in finders:
                finder.search(words, spans, here)
            names = sorted({items[x][0] for x in here} - {None})
            n_hit = sum(b - a for a, b in decontaminate.merged(spans))
            assert (len(words), n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0) == contaminated(doc, found)


def test_tables_of_a_full_block_are_small():
    """Words that are nearly all distinct are the worst case."""
    rng = np.random.default_rng(4)
    items, size = [], 0
    while size < decontaminate.BLOCK_BYTES:
        items.append((str(len(items)), b" ".join(b"w%d" % x for x in rng.integers(3_000_000, size=60))))
        size += len(items[-1][1]) + 16
    tracemalloc.start()
    finders = decontaminate.searchers(items, 10)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    print(f"{held / 1e6:.0f} MB held, {peak / 1e6:.0f} MB at most")
    assert len(finders) == 1 and peak < 200e6


# 6


def test_embedding_links_are_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = [(k, (base[k % 40] + rng.normal(size=16) * (0.02 + 0.2 * (k % 3))).astype(np.float32).astype(float).tolist(), k % 2) for k in range(400)]
    rows += [(400 + k, rows[0][1], 0) for k in range(30)] + [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, rows[1][1], None), (504, [None] + [1.0] * 15, 0), (505, [], 0), (None, rows[0][1], 0), (7, rows[7][1], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit(1))).collect()}
    x = np.array([v for _, v, _ in rows[:430]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([y for _, _, y in rows[:430]])
    near = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    top = components([r[0] for r in rows[:430]], [(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(near), strict=True)])
    assert all(got[rows[k][0]] == (near[k].sum(), top[rows[k][0]], top[rows[k][0]] == rows[k][0]) for k in range(430))
    assert all(got[k] == (0, k, True) for k in range(500, 506)) and got[None] == (0, None, False)


def test_embedding_links_over_several_shards_are_brute_force(spark):
    """Shards of 100 nodes, blocks of 64, one dense group over all shards; audits ask for every link."""
    rng = np.random.default_rng(7)
    base, dense = rng.normal(size=(60, 16)), rng.normal(size=16)
    rows = [(k, ((base[k % 60] if k % 3 else dense) + rng.normal(size=16) * 0.05).tolist(), 1) for k in range(700)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame, shard_bytes=100 * 16 * 8, block=64).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    top = components(range(700), zip(*np.nonzero(near), strict=True))
    assert sum(n for n, _ in got.values()) >= 0.99 * near.sum() and all(got[k][0] <= near[k].sum() for k in range(700))
    assert sum(got[k] == (near[k].sum(), top[k]) for k in range(700)) >= 0.97 * 700
    assert embedding_dedup.near_duplicates(frame.limit(0)).collect() == []


def test_nodes_without_a_path_are_compared(spark):
    from strainspark.llm.hnsw import Graph

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)) + rng.normal(size=8)
    graph = Graph(embedding_dedup.unit(x).astype(np.float32), np.arange(300)).build()
    raw = x[graph.ids]
    graph.levels[0][np.isin(graph.levels[0], [250, 260])] = -1
    assert {250, 260} <= set(graph.strays())
    out = embedding_dedup.linked(graph, raw, graph.ids, raw, 0.93, np.ones(300, np.int64))
    near = embedding_dedup.unit(raw) @ embedding_dedup.unit(raw).T >= 0.93
    assert out.count.sum() >= 0.99 * (near.sum() - 300) and out.count[250] == near[250].sum() - 1


def test_graph_recall():
    from strainspark.llm.hnsw import Graph

    rng = np.random.default_rng(1)
    x = (rng.normal(size=(60, 32))[rng.integers(60, size=1500)] + 0.25 * rng.normal(size=(1500, 32))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = Graph(x, np.arange(1500)).build()
    q, n = graph.query(x, 64, 0.9)
    found = {(int(a), int(graph.ids[b])) for a, b in zip(q, n, strict=True)}
    true = {(int(a), int(b)) for a, b in zip(*np.nonzero(x @ x.T >= 0.9), strict=True)}
    assert len(found & true) >= 0.95 * len(true)


# 7


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_are_brute_force(spark, data):
    docs = documents(spark, data)
    sets, links = {k: shingles(t) for k, t in docs.items()}, []
    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                links.append((a, b))
    top = components(docs, links)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op7_minhash_dedup(spark, data).collect()}
    assert got == {k: (len(sets[k]), top[k], top[k] == k) for k in docs} and links


def test_a_large_group_of_near_copies_with_loose_ends(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(700):
        own = list(words)
        for x in rng.integers(120, size=rng.integers(0, 12)):
            own[x] = f"e{k}_{x}"
        texts.append(" ".join(own))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(700) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    top = components(range(700), links)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(rows).collect()}
    assert got == top and len(set(top.values())) > 5


def test_near_duplicates_of_odd_rows(odd, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(odd).collect()]
    assert len(got) == 10 and (2, 0, 2, True) in got and (3, 0, 3, True) in got and (7, 29_997, 6, False) in got and got.count((8, 2, 8, True)) == 2
    assert (None, 1, None, False) in got
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    rows = [(1, two), (1, one), (2, one + " end"), (3, two + " end"), (4, three), (4, three + " end"), (4, three), (5, "start " + three)]
    found = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (4, 4, True), (5, 4, False)]
    assert len({r.group for r in found}) == 3


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(4)
    a, b = minhash_dedup._coefficients()
    for similarity in (0.75, 0.9):
        off = []
        for _ in range(40):
            both = rng.integers(2**63, size=400).astype(np.uint64)
            n = round(400 * (1 - similarity) / similarity / 2)
            x, y = (np.concatenate([both, rng.integers(2**63, size=n).astype(np.uint64)]) for _ in range(2))
            sx, sy = (minhash_dedup.odd_sketch(minhash_dedup.signature(s, a, b)) for s in (x, y))
            off.append(int(np.bitwise_count(sx ^ sy).sum()))
        assert abs(np.mean(off) - minhash_dedup.expected_parity(similarity)) < 5
        assert max(off) <= minhash_dedup._most_parity(0.75)


# 8


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar(a, b):
    return edits(a, b) <= int(max(len(a), len(b)) * 0.1 + 1e-9)


def test_line_groups_are_brute_force(spark):
    rng = np.random.default_rng(6)
    words = [f"tok{k}" for k in range(50)]
    lines = []
    for _ in range(15):
        base = [words[x] for x in rng.integers(50, size=rng.integers(1, 60))]
        lines.append(base)
        for _ in range(6):
            own = list(base)
            own[rng.integers(len(own))] += "x" if rng.random() < 0.8 else ""
            lines.append(own)
    lines.append([f"long{k}" for k in range(400)])
    lines.append([f"long{k}" for k in range(399)])
    rows = [(k, "\n".join([" ".join(line).capitalize() + ".", "", "--"])) for k, line in enumerate(lines)]
    norms = [re.sub(r"[^a-z0-9]+", " ", " ".join(line)).strip() for line in lines]
    links = [(a, b) for a in range(len(lines)) for b in range(a) if abs(len(norms[a]) - len(norms[b])) <= 0.1 * max(len(norms[a]), len(norms[b])) and similar(norms[a], norms[b])]
    top = components(range(len(lines)), links)
    groups = {r.doc_id: r for r in line_dedup.line_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    by_group = {}
    for k, r in groups.items():
        by_group.setdefault(r.group, set()).add(k)
    # No line is in a group that edit similarity alone doesn't connect, the first of each is kept, and few links are missed,
    # more of them in short lines, where one edit changes much of the weight.
    assert all(len({top[k] for k in x}) == 1 for x in by_group.values())
    assert all(groups[k].kept == (k == min(x)) for x in by_group.values() for k in x)
    long = [groups[a].group == groups[b].group for a, b in links if len(lines[a]) >= 20]
    print("joined", np.mean([groups[a].group == groups[b].group for a, b in links]), "of 20 words and more", np.mean(long))
    assert np.mean(long) >= 0.97 and np.mean([groups[a].group == groups[b].group for a, b in links]) >= 0.9


def test_tight_groups_and_very_long_lines(spark):
    """A group larger than a bucket's share, permuted words of equal SimHashes, and lines of 20,000 characters."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), size=rng.integers(3, 10)))
    base = [word() for _ in range(40)]
    near = [" ".join([*base[:k % 40], word(), *base[k % 40 + 1 :]]) for k in range(300)]
    bag = [word() for _ in range(30)]
    turned = [" ".join(bag), " ".join(bag[15:] + bag[:15]), " ".join(bag[15:] + bag[:15][::-1])]
    long = [word() for _ in range(3000)]
    far = [" ".join(long), "five words are put before " + " ".join(long), " ".join(long[:2000] + [word() for _ in range(900)] + long[2900:])]
    texts = [*near, *turned, *far]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {r.doc_id: r.group for r in line_dedup.line_groups(rows).collect()}
    joined = sum(group[k] == group[0] for k in range(300))
    assert joined >= 270 and len({group[k] for k in (300, 301, 302)}) == 3
    assert group[303] == group[304] != group[305] and len(texts[303]) > 15_000


def test_recall_of_similar_lines(spark):
    """Of pairs that edit similarity alone links, at least nine of ten meet; the bits of SimHashes aren't asked."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), size=rng.integers(2, 10)))
    pairs = []
    while len(pairs) < 120:
        base = [word() for _ in range(rng.integers(8, 45))]
        own = list(base)
        for k in rng.choice(len(own), size=rng.integers(1, 2 + len(own) // 12), replace=False):
            own[k] = word()
        a, b = " ".join(base), " ".join(own)
        if a != b and edits(a, b) <= int(max(len(a), len(b)) * 0.1 + 1e-9):
            pairs.append((a, b))
    rows = [(2 * k + side, pair[side]) for k, pair in enumerate(pairs) for side in (0, 1)]
    groups = {r.doc_id: r.group for r in line_dedup.line_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(groups[2 * k] == groups[2 * k + 1] for k in range(len(pairs))) >= 0.9 * len(pairs)
    assert len({groups[2 * k] for k in range(len(pairs))}) == len(pairs)


def test_long_lines_are_compared_whole(spark):
    """Words put in front of a long line shift all pieces, but not the distance."""
    rng = np.random.default_rng(9)
    base = ["".join(rng.choice(list("abcdefghijklmnop"), size=rng.integers(3, 9))) for _ in range(320)]
    x = " ".join(base)
    far = " ".join(base[:200] + base[:40] + base[240:])
    rows = [(x, "new words here " + x), (x, "eight more words are put in front here " + x), (x, far), (x, x[:-1])]
    truth = [edits(a, b) <= int(max(len(a), len(b)) * 0.1 + 1e-9) for a, b in rows]
    words = "a b c a b ab ba c cc abc".split()
    for _ in range(300):  # short lines of few words, where all the shortcuts meet
        own = [str(x) for x in rng.choice(words, size=rng.integers(1, 16))]
        other = list(own)
        for _ in range(rng.integers(0, 3)):
            at = rng.integers(0, len(other) + 1)
            other[at : at + rng.integers(0, 2)] = [str(x) for x in rng.choice(words, size=rng.integers(0, 2))]
        rows.append((" ".join(own), " ".join(other) or "a"))
    truth += [edits(a, b) <= int(max(len(a), len(b)) * 0.3 + 1e-9) for a, b in rows[4:]]
    short = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)][4:], "k int, x string, y string").transform(lambda f: line_dedup.with_similar(f, "x", "y", 0.7, "near")).orderBy("k").collect()
    assert [r.near for r in short] == truth[4:] and 0 < sum(truth[4:]) < 300
    rows, truth = rows[:4], truth[:4]
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, x string, y string").transform(lambda f: line_dedup.with_similar(f, "x", "y", 0.9, "near")).orderBy("k").collect()
    assert len(x) > 1000 and truth == [True, True, False, True]
    assert [r.near for r in got] == truth


def test_lines_of_odd_rows(odd, empty):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.dropped) for r in line_dedup.report(odd).collect()}
    assert got[2] == got[3] == got[5] == (0, 0, "") and got[9] == (3, 1, "2") and got[8] == (1, 0, "")
    clean = line_dedup.deduplicated(odd, line_dedup.line_groups(odd))
    assert {r.doc_id: r.text for r in clean.collect()}[9] == "A\nB" and clean.columns == odd.columns
    assert line_dedup.report(empty).count() == 0


# 9


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert secrets.trigram_query("[0-9a-f]+") is True
    assert secrets.trigram_query("(abc|xyz)?q+") is True
    assert secrets.trigrams(secrets.trigram_query("abc(def|ghi)")) >= {"abc", "def", "ghi"}


def spans_of(text):
    found = []
    for place, rule in enumerate(secrets.BASE_RULES + secrets.MORE_RULES):
        found += [(m.start(), place, f"{rule.kind}:{m.start()}:{m.end()}") for m in re.finditer(rule.pattern, text or "") if len(m[rule.group]) >= rule.least]
    return [x for _, _, x in sorted(found)]


def test_secrets_are_brute_force(spark, odd, data):
    tricky = ["é😀 password: 'abcdef' token=abc secret==== api-key=x API_KEY: zzzzzzz", "AKIA" + "A" * 16 + " AKIAxx " + "f" * 24 + "g" + "0" * 23, "passwordpassword=\"abcdefg\" passwd=1234567passwd=1234567", "Bearer " + "a" * 30, "ghp_" + "A1" * 18, "-----BEGIN RSA PRIVATE KEY-----", "ſecret=abcdefgh toKen=abcdefgh"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(tricky)], "doc_id long, text string").union(odd.select("doc_id", "text")).union(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"))
    got = secrets.find_secrets(rows, secrets.BASE_RULES + secrets.MORE_RULES).collect()
    assert len(got) == rows.count()
    assert all([f"{s['kind']}:{s['start']}:{s['end']}" for s in r.spans] == spans_of(r.text) for r in got)
    assert secrets.report(rows.limit(0)).count() == 0


# 10


def verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = lower(host)
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, "allow"))


def test_urls_are_brute_force(spark):
    rules = [*url_filter.RULES, ("block", "a-b.com", ""), ("allow", "b.a-b.com", "/x"), ("block", "org", "/es/1"), (None, "net", "/"), ("allow", "net", "/de/")]
    hosts = ["com", "example.com", "a.example.com", "xcom", "EXAMPLE.net", "a-b.com", "b.a-b.com", "c.b.a-b.com", "a.com", "com.", "", "org", "x.org", "exa-mple.com", "example.com.evil.net"]
    urls = [f"http://{h}{p}{s}" for h in hosts for p in ("", "/", "/en/", "/en/77", "/de/8", "/es/12", "/x") for s in ("", "?q=/en/", "#z")] + [None, "", "nothing", "a://b://c/en/", "http://u@com/en/", "x\ny://com/en/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("extra"))
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(rows, table).collect()}
    known = [r for r in rules if r[0]]
    assert got == {k: verdict(u, known) for k, u in enumerate(urls)}
    assert url_filter.judge(rows.limit(0), table).count() == 0
    assert url_filter.judge(rows, table.limit(0)).filter("verdict <> 'allow'").count() == 0


def test_urls_repeated_long_and_in_any_number_of_sweeps(spark):
    far = "http://a.example.com/en/7" + "x" * 300_000
    urls = [far, far, "http://" + "a." * 50_000 + "net/de/1", None, None, "http://org/es/"] * 3
    rows = spark.createDataFrame([(7, u) for u in urls], "page_id long, url string")
    table = url_filter.rule_table(spark)
    assert sorted(tuple(r) for r in table.collect()) == sorted(url_filter.RULES)
    wanted = sorted((len(u or ""), *verdict(u, url_filter.RULES)[2:]) for u in urls if u) + [(0, None, "allow")] * 6
    for slices in (None, 1, 5):
        got = [(len(r.url or ""), r.rule, r.verdict) for r in url_filter.judge(rows, table, slices=slices).collect()]
        assert sorted(got, key=str) == sorted(wanted, key=str)


def test_lines_of_over_a_million_characters(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = ["".join(map(chr, rng.integers(97, 123, 3))) for _ in range(3_000)]
    line = lambda low, high: [words[k] for k in rng.integers(low, high, 400_000)]
    first, other = line(0, 1_500), line(1_500, 3_000)  # lines of the same words in like numbers have like SimHashes
    near = [w if k % 40 else words[k % 1_499] for k, w in enumerate(first)]  # one word in forty, by many others
    texts = [(1, " ".join(first)), (2, " ".join(other)), (3, " ".join(near)), (4, "few words here")]
    assert len(texts[0][1]) > line_dedup.MOST_WEIGHT
    lines = spark.createDataFrame([(bytes([k]), len(t), t) for k, t in texts], "id binary, n int, norm string")
    sims = {r.id[0]: (r.sim, r.sim2) for r in line_dedup.simhashes(lines).collect()}
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(sims[a], sims[b], strict=True))
    assert all(any(s) for s in sims.values()) and apart(1, 2) > line_dedup.MOST_BITS >= apart(1, 3)
    monkeypatch.setattr(line_dedup, "MOST_WEIGHT", 0)
    assert {r.id[0]: (r.sim, r.sim2) for r in line_dedup.simhashes(lines.filter("n < 100")).collect()} == {4: sims[4]}
    monkeypatch.undo()
    found = {r.doc_id: (r.group, r.kept) for r in line_dedup.line_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found[1][0] == found[3][0] and len({g for g, _ in found.values()}) == 3 and [found[k][1] for k in (1, 2, 3, 4)] == [True, True, False, True]
