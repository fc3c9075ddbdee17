"""Token alignment, fingerprints and the filter audit against brute force, and their edge cases."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strainspark.llm import alignment, filter_audit, fingerprints, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string"
LONG = " ".join(f"word{k}" for k in range(30_000))
TEXTS = ["the cat sat. On the mat!", None, "", "  two  spaces\n\nand\ttabs ", "naïve ½ ② 的是 ﬁ é", "<|endoftext|> <s></s><0x0A>", "the cat sat. On the mat!", "ﷺ" * 5, "a" * 3000, "▁x", LONG]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ids that repeat and clashing extra columns."""
    rows = [(k, x, None if k % 3 == 0 else f"l{k % 2}", None) for k, x in enumerate(TEXTS)] + [(None, "no id. Here", "l0", "s"), (None, "no id. There", None, "s"), (0, "another text. Of zero", "l1", "s"), (4, TEXTS[4], "l1", None), (2**60 + 1, "far\nout", "", "s")]
    return spark.createDataFrame(rows, DOCS).withColumns({x: F.lit("extra") for x in ("id", "h", "part", "mask", "chunk", "n", "own", "half")})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def key(row):
    return tuple((x is not None, str(x)) for x in row)


# 11


def aligned(text, a, b, a_bytes, b_bytes):
    """(groups as lists of ids, links) from the libraries' own encoders."""
    if not text:
        return [], []
    ids, others = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    whole = (" " + text).encode()
    if b"".join(a_bytes[x] for x in ids) != whole or b"".join(b_bytes[x] for x in others) != whole:
        return [], []
    ends_a, ends_b = (list(itertools.accumulate(len(t[x]) for x in y)) for t, y in ((a_bytes, ids), (b_bytes, others)))
    groups, low = [], 0
    for end in sorted(set(ends_a) & set(ends_b)):
        groups.append(([x for x, e in zip(ids, ends_a, strict=True) if low < e <= end], [x for x, e in zip(others, ends_b, strict=True) if low < e <= end]))
        low = end
    return groups, [(x, y) for p, q in groups for x in p for y in q]


def brute_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {chr(x): x for x in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
    letters |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if chr(x) not in letters)}
    a_bytes = {k: bytes(letters.get(c, 0) for c in x) for x, k in a.get_vocab().items()}
    b_bytes = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in range(b.get_piece_size())]
    found = [aligned(x, a, b, a_bytes, b_bytes) for x in texts]
    count = Counter(pair for _, links in found for pair in set(links))
    most = [defaultdict(int), defaultdict(int)]
    for pair, n in count.items():
        for side in (0, 1):
            most[side][pair[side]] = max(most[side][pair[side]], n)
    out = []
    for groups, links in found:
        spelled = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links), sum(count[x] == most[0][x[0]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(spelled.encode()).hexdigest() if groups else "", sum(count[x] == most[1][x[1]] for x in links)))
    return out


@pytest.mark.parametrize("most", [alignment.CHUNK_LINKS, 40])
def test_alignment_is_that_of_brute_force(spark, odd, most, monkeypatch):
    short = odd.filter("text IS NULL OR length(text) < 5000").union(spark.createDataFrame([(100 + k, f"Hashing {k} ünïcode-words, 12{k} kg — it's {'x' * k}", "l0", "s", *["extra"] * 8) for k in range(30)], odd.schema))
    rows = short.select("doc_id", "text").collect()
    monkeypatch.setattr(alignment.align_corpus, "__defaults__", ("doc_id", "text", most))
    got = [tuple(r) for r in alignment.report(short, A, B).collect()]
    wanted = [(r.doc_id, *x) for r, x in zip(rows, brute_alignment([r.text for r in rows]), strict=True)]
    assert sorted(got, key=key) == sorted(wanted, key=key)


def test_alignment_of_the_query_is_that_of_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").filter("length(text) < 3000").select("doc_id", "text")
    held = rows.collect()
    wanted = [(r.doc_id, *x) for r, x in zip(held, brute_alignment([r.text for r in held]), strict=True)]
    assert sorted(map(tuple, alignment.report(rows, A, B).collect())) == sorted(wanted)
    assert queries.op11_token_alignment(spark, data).count() == spark.read.parquet(f"{data}/documents.parquet").count()


def test_alignment_of_long_groups_and_texts(spark, monkeypatch):
    one = alignment.Aligner(A, B)
    plain = one.align("wörter über ② alles 的是 不 " * 20)
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 1)
    blocks = one.align("wörter über ② alles 的是 不 " * 20)
    assert plain[:5] == blocks[:5] and all((x == y).all() for x, y in zip(plain[5:], blocks[5:], strict=True))
    long = one.align(LONG * 5)
    assert long[3] == long[6].sum() >= long[0] > 200_000
    met = alignment.merge_ends(np.array([1, 3, 6, 9]), np.array([3, 4, 6, 7, 8, 9]))
    assert [x.tolist() for x in met] == [[2, 3, 4], [1, 3, 6]]
    assert alignment.report(empty(spark), A, B).count() == 0


# 12


def plain_print(text):
    pieces = [x for x in re.sub(r"([.!?])[ \t\r]+", r"\1\n", text or "").split("\n") if re.search(r"[^ \t-\r]", x)]
    digests = [hashlib.md5(x.encode()).hexdigest() for x in pieces]
    lanes = np.zeros(120, np.int64)
    for x in digests:
        halves = [int(x[:15], 16), int(x[15:30], 16)]
        lanes += np.array([halves[w // 20] >> (w % 20 + 20 * at) & 1 for w in range(40) for at in range(3)])
    words = [sum(int(lanes[3 * w + at]) << 20 * at for at in range(3)) for w in range(40)]
    total = sum(int(x[15:30], 16) & (1 << 31) - 1 for x in digests)
    return f"{len(pieces):08x}{total:016x}" + "".join(f"{w:015x}" for w in words), 2 * lanes - len(pieces)


def plain_likeness(x, y):
    whole = int(x @ x + y @ y)
    return 1.0 if not whole else min(1.0, max(0.0, int(2 * (x @ y)) / whole))


def test_fingerprints_are_those_of_a_plain_model(odd):
    rows = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).digest()))
    after = {x: order[(k + 1) % len(order)][1] for k, x in enumerate(order)}
    wanted = []
    for row in rows:
        text, half = row[1], len(row[1]) // 2
        edited = text[: len(text) - half] + after[row][:half]
        (own, s), (other, t), (_, u) = plain_print(text), plain_print(edited), plain_print(after[row])
        wanted.append((row[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, plain_likeness(s, t), plain_likeness(s, u)))
    for got, want in zip(sorted(map(tuple, fingerprints.report(odd).collect()), key=key), sorted(wanted, key=key), strict=True):
        assert got[:3] == want[:3] and got[5:] == want[5:] and got[3] == want[3] and got[4] == want[4], (got[0], got[5:], want[5:])


def test_fingerprint_of_one_document_and_of_none(spark):
    one = spark.createDataFrame([(7, "alone. here")], "doc_id long, text string")
    row = fingerprints.report(one).first()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"alone.alone").hexdigest()
    assert fingerprints.report(empty(spark)).count() == 0


def test_order_insertion_and_deletion(spark):
    rows = spark.createDataFrame([("One. Two here.\nThree.", "Three.\nOne.\n\nTwo here.", "Three.", "One. Two here.")], "x string, y string, part string, rest string")
    of = {c: fingerprints.fingerprint(F.col(c)) for c in rows.columns}
    row = rows.select(fingerprints.as_text(of["x"]).alias("x"), fingerprints.as_text(of["y"]).alias("y"), fingerprints.as_text(of["rest"]).alias("rest"),
                      fingerprints.as_text(fingerprints.inserted(of["rest"], of["part"])).alias("whole"), fingerprints.as_text(fingerprints.deleted(of["x"], of["part"])).alias("less")).first()
    assert row.x == row.y == row.whole and row.less == row.rest != row.x


def test_lanes_wrap_without_touching_their_neighbours(spark):
    n = (1 << fingerprints.LANE_BITS) + 3
    hashes = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct(F.lit(fingerprints.ONES).alias("a"), F.lit(0).cast("long").alias("b")))
    row = spark.range(1).select(fingerprints.of_hashes(hashes).alias("f")).first().f
    assert row.n == n and row.words[0] == 3 * fingerprints.ONES and not any(row.words[20:])
    far = spark.range(1).select(fingerprints.signs(fingerprints.of_hashes(hashes)).alias("s")).first().s
    assert far[0] == n - (2 << fingerprints.LANE_BITS)


def test_likeness_follows_the_shared_paragraphs(spark):
    def text(low, high):
        return "\n".join(f"paragraph {k} of some length" for k in range(low, high))

    rows = spark.createDataFrame([(text(0, 400), text(high - 400, high), high) for high in (400, 500, 600, 800)], "x string, y string, high int")
    sign = lambda c: fingerprints.signs(fingerprints.fingerprint(F.col(c)))
    got = {r.high: r.near for r in rows.select("high", fingerprints.likeness(sign("x"), sign("y")).alias("near")).collect()}
    assert got[400] == 1.0 and abs(got[500] - 0.75) < 0.2 and abs(got[600] - 0.5) < 0.25 and got[800] < 0.25


# 13


def fails(text):
    words = re.findall(r"[^ \t-\r]+", text)
    return [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text))]


def plain_audit(rows, labels):
    marks = {x: {r[0] for r in labels if r[1 + k] == 1} for k, x in enumerate(("good", "toxic"))}
    parts = defaultdict(list)
    least = {}
    for k, text, _ in rows:
        if k is not None:
            least[text or ""] = min(k, least.get(text or "", k))
    for k, text, lang in rows:
        text = text or ""
        parts[lang or ""].append((dict(zip("ABCDE", [*fails(text), k is not None and k > least[text]], strict=True)), k is not None and k in marks["good"], k is not None and k in marks["toxic"]))
    out = []
    for part, docs in parts.items():
        shapley = Counter()
        made = []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if d[0][f]], [d for d in left if not d[0][f]]
                shapley[f] += len(gone)
                redundant = sum(d[0][f] for d in docs) - len(gone)
                made.append((part, "".join(order), step, len(left), len(gone), redundant, sum(d[0][f] and sum(d[0].values()) == 1 for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out += [(*x[:9], shapley[x[9]]) for x in made]
    return out


def test_audit_is_that_of_removing_documents_one_filter_at_a_time(spark, odd, data):
    labels = [(0, 1, 0), (0, 0, 1), (2, None, 1), (None, 1, 1), (6, 1, None), (4, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit(1))
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang").collect()]
    got = [tuple(r) for r in filter_audit.report(odd, table).collect()]
    assert sorted(got) == sorted(plain_audit(rows, labels)) and len(got) == 600 * len({r[2] or "" for r in rows})
    docs = spark.read.parquet(f"{data}/documents.parquet")
    marks = spark.read.parquet(f"{data}/labels.parquet")
    got = [tuple(r) for r in filter_audit.report(docs, marks).collect()]
    assert sorted(got) == sorted(plain_audit([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], [tuple(r) for r in marks.select("doc_id", "quality", "toxic").collect()]))
    assert filter_audit.report(empty(spark), table).count() == 0
    assert filter_audit.report(odd, table.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_swaps_visit_every_order_once():
    for k in range(1, 7):
        order, seen = list(range(k)), [tuple(range(k))]
        for p in filter_audit.adjacent_swaps(k):
            order[p], order[p + 1] = order[p + 1], order[p]
            seen.append(tuple(order))
        assert len(seen) == len(set(seen)) == len(list(itertools.permutations(range(k))))
