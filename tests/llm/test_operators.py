"""Each training-data operator against brute force, and on odd tables: nulls, empty and long texts, repeated rows, no rows, extra columns."""

import hashlib
import io
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnflow.llm import archives, decontamination, encoding, extraction, fingerprints, mixing, neardup, packing, privacy, quality, tokenfiles
from tarnflow.llm.graphs import components

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket string, mark string"
ODD = [
    (None, "no id at all", "en"), (1, None, "en"), (2, "", None), (3, "   \n\t ", "fr"), (4, "one", "en"), (4, "one", "en"), (5, "One two  three\n four", ""),
    (6, "word " * 9000, "de"), (7, "x" * 60_000, "en"), (9, "tschüß 𝄞 é́ \x1c\x85 end", "xx"), (9, "another text of the same id here", "en"),
    (10, "a.b@c.de. 1.2.3.4 1.2.3.400, 4111 1111 1111 1111, +1 (743) 555-3824, " + "9" * 5000 + " " + "1 " * 3000, "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, g, "s", 0 if t is None else len(t), "clash", "clash") for i, t, g in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


# ------------------------------------------------------------------ fingerprints
def slow_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=64), st.text("abcd", max_size=64))
def test_edit_distance(a, b):
    assert fingerprints.edits(a, b) == slow_edits(a, b)


def slow_fingerprint(text):
    """Byte by byte: the hash of the last seven bytes decides where a piece ends."""
    def signed(block):
        letters, begin, window = [], 0, [0] * 7
        for k, byte in enumerate(text):
            window = [byte + 1, *window[:6]]
            h = sum(x * 0x01000193**j for j, x in enumerate(window)) % 2**32
            h ^= h >> 15
            h = h * 0x2C1B3C6D % 2**32
            h ^= h >> 13
            if h % block == block - 1 and len(letters) < 63:
                letters.append(fingerprints.ALPHABET[xxhash.xxh32_intdigest(bytes(text[begin : k + 1])) % 64])
                begin = k + 1
        return "".join(letters) + (fingerprints.ALPHABET[xxhash.xxh32_intdigest(bytes(text[begin:])) % 64] if begin < len(text) else "")

    block = 3
    while block * 64 < len(text):
        block *= 2
    while block > 3 and len(signed(block)) < 32:
        block //= 2
    return f"{block}:{signed(block)}:{signed(2 * block)}" if text else "3::"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 12))
def test_fingerprints_byte_by_byte(data, repeat):
    assert fingerprints.fingerprint(data * repeat) == slow_fingerprint(data * repeat)


def test_fingerprints(docs, texts):
    rows = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    order = sorted(texts)
    assert sorted(rows) == order
    near, far = [], []
    for k, i in enumerate(order):
        following = texts[order[(k + 1) % len(order)]]
        changed = fingerprints.edited(texts[i], following)
        r = rows[i]
        assert r["n_chars"] == len(texts[i]) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.fingerprint(texts[i].encode()) and r["edited_fingerprint"] == fingerprints.fingerprint(changed.encode())
        assert r["near_next"] == fingerprints.likeness(r["fingerprint"], fingerprints.fingerprint(following.encode()))
        near.append(r["near_edited"])
        far.append(r["near_next"])
    assert np.mean(near) > 0.5 and np.mean(far) < 0.1


def test_fingerprints_of_odd_rows(odd, none):
    rows = fingerprints.fingerprints(odd).collect()
    assert len(rows) == len(ODD) and fingerprints.fingerprints(none).count() == 0
    same = [r for r in rows if r["doc_id"] == 4]
    assert same[0]["fingerprint"] == same[1]["fingerprint"] and sorted(r["near_next"] for r in same)[1] == 1.0
    assert fingerprints.likeness("3::", "3::") == 1.0 and fingerprints.likeness("3::", "3:abc:a") == 0.0


# ------------------------------------------------------------------ encoding and token files
@pytest.mark.parametrize(("path", "ends"), [(BYTE, False), (WORD, True)])
def test_pieces_encode_as_the_library_does(path, ends, texts):
    samples = [*list(texts.values())[:60], *(t or "" for _, t, _ in ODD), " lead", "trail ", "a  b", "x \n y", "it's we'll <|endoftext|> don't<|endoftext|>", "É é ﬁ ½ 12ab34"]
    library = Tokenizer.from_file(path)
    for text, raw in zip(samples, encoding.encoder(path, ends).encode(samples)):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=12), st.sampled_from(["bit", "byte"]))
def test_token_file_round_trip(lists, kind):
    given_ = [(None if k % 5 == 3 else -(2**63) if k % 5 == 4 else k, np.array(x, "<u4").tobytes()) for k, x in enumerate(lists)]
    data = b"".join(tokenfiles.file_of(iter(given_), kind, chunk=16))
    reader = tokenfiles.TokenFile(io.BytesIO(data))
    assert list(reader.documents()) == given_ and reader.total == sum(map(len, lists))
    flat = [x for part in lists for x in part]
    assert reader.ids(3, 29).tolist() == flat[3:29]
    with pytest.raises(ValueError):
        tokenfiles.TokenFile(io.BytesIO(data[:-1]))


def brute_tokens(rows):
    library, out, start = Tokenizer.from_file(BYTE), [], 0
    for i, t in sorted(rows, key=lambda x: (-(2**63) if x[0] is None else x[0], x[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(docs, texts, odd, none):
    key = lambda x: x[1]
    assert sorted(map(tuple, tokenfiles.token_files(docs, BYTE, 2).collect()), key=key) == brute_tokens(texts.items())
    assert sorted(map(tuple, tokenfiles.token_files(odd, BYTE, 2, kind="byte").collect()), key=key) == brute_tokens([x[:2] for x in ODD])
    assert tokenfiles.token_files(none, BYTE, 2).count() == 0


# ------------------------------------------------------------------ packing
def slow_best_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= x]
        if fit:
            bins[min(fit, key=lambda b: bins[b])] -= x
        else:
            bins.append(capacity - x)
    return len(bins), sorted(bins)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=120))
def test_best_fit_on_the_histogram(lengths):
    steps, n = packing.best_fit_decreasing(dict(Counter(lengths)), 60)
    want, rest = slow_best_fit(lengths, 60)
    assert n == want
    used = {}
    for length, rank, count, first, offset in steps.tolist():
        for k in range(count):
            used.setdefault(first + k, []).append((offset, length))
    left = []
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        left.append(60 - at)
    assert sorted(left) == rest


def test_packing(docs, texts, odd, none):
    library = Tokenizer.from_file(WORD)
    for frame, given_ in ((docs, list(texts.items())), (odd, [x[:2] for x in ODD])):
        rows = packing.pack(frame, WORD, 1).collect()
        want = []
        for i, t in given_:
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
            want += [(i, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
        key = lambda x: tuple(-1 if v is None else v for v in x)
        assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
        bins = {}
        for r in rows:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(bins) == slow_best_fit([x[3] for x in want], 4096)[0]
    assert packing.pack(none, WORD, 1).count() == 0


# ------------------------------------------------------------------ extraction
PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies on this site, which is a long sentence about nothing at all.</div>
<article><h1>A &amp; B</h1><p>First  paragraph of some length, with <b>bold &eacute;</b> text
in it.<p>Ok.<aside>Related things that one may read</aside><ul><li>item one<li>item two</ul><script>var x = "<p>no</p>";</script>
<form><p>Sign up</p></form></article><section id="comments"><p>A reader's comment that goes on for a good while, longer than the rest.</p></section>
<footer>&copy; 2024</footer></body></html>"""


def test_main_text():
    assert extraction.main_text(PAGE) == "A & B First paragraph of some length, with bold é text in it. Ok. item one item two"
    assert extraction.main_text(None) == extraction.main_text("") == extraction.main_text("<p></p><br>") == ""
    assert extraction.main_text("just text &lt;3") == "just text <3"
    assert extraction.main_text("<p>a" * 3000).count("a") == 3000


LINKS = "".join(f"<div><a href='/{k}'>{w}</a> <a href='/x'>more</a> <a href='/y'>on it</a></div>" for k, w in enumerate("Home News Sport Travel Money Weather Shops Jobs".split()))
BODY = "<h1>A title of the page</h1>" + "".join(f"<p>{w} paragraph that goes on for long enough to be told from the links of the page, sentence after sentence.</p>" for w in ("First", "Second", "Third")) + "<p>Ok.</p><p>The last one is long again, and says in many words what could be said in few.</p>"
TOLD = "A title of the page " + " ".join(f"{w} paragraph that goes on for long enough to be told from the links of the page, sentence after sentence." for w in ("First", "Second", "Third")) + " Ok. The last one is long again, and says in many words what could be said in few."


@pytest.mark.parametrize("page", [
    "<body><div>{links}</div><div>{body}</div></body>",  # nothing but the ratios tells them apart
    "<body><div>{links}</div><div class='page'><div><div>{body}</div></div></div><div>{links}</div></body>",
    "<body><div class='sidebar'>{links}</div><div class='comment-form widget'>{body}</div></body>",  # a misleading name
    "<body><div class='has-sidebar ad-free'><div>{links}</div><section id='share-prices'>{body}</section></div></body>",
    "<body><div>{links}</div><main><div class='story'><div>{body}</div></div><div class='newsletter'>{links}</div></main></body>",
    "<body><article>{body}<div class='related'>{links}</div></article><div id='comments'><div class='comment'><p>A reader wrote this, and it is as long as any paragraph of the article itself, or longer still.</p></div></div></body>",
])
def test_main_text_without_article_or_with_misleading_names(page):
    assert extraction.main_text(page.format(links=LINKS, body=BODY)) == TOLD


def test_ratios_decide(monkeypatch):
    page = f"<body><div>{LINKS}</div><div>{BODY}</div></body>"
    monkeypatch.setattr(extraction, "smoothed", lambda ratios: np.ones(len(ratios)))
    assert extraction.main_text(page) != TOLD  # all ratios alike: the links are content too
    monkeypatch.setattr(extraction, "smoothed", lambda ratios: ratios[::-1])
    assert extraction.main_text(page) != TOLD


def test_names_of_text_drop_nothing():
    page = "<body><article><h1 class='page-header'>Title</h1><p>Body of it.</p><p class='share-price'>Shares rose.</p><p class='notice'>And so on.</p></article></body>"
    assert extraction.main_text(page) == "Title Body of it. Shares rose. And so on."


def test_odd_pages(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars int"
    rows = [(None, None, None, "clash", 1), (1, "u", "", "clash", 1), (2, "u", "<article>Same</article>", "clash", 1), (2, "u", "<article>Same</article>", "clash", 1), (3, "", "<p>" + "word " * 100_000, "clash", 1), (4, "u", "<<<>>&&&amp;", None, None)]
    found = extraction.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in found) == [(0, 0), (1, 0), (2, 4), (2, 4), (3, 499_999), (4, len(extraction.main_text("<<<>>&&&amp;")))]
    assert extraction.extract(spark.createDataFrame([], schema)).count() == 0


def test_pages(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    rows = {r["page_id"]: r for r in extraction.extract(pages).collect()}
    for r in pages.collect():
        inside = re.search("<article>(.*?)</article>", r["html"], re.S).group(1)
        import html

        want = " ".join(html.unescape(re.sub("<br>|</?b>", " ", re.sub("</?(?:p|h1)>", " ", inside))).split())
        assert rows[r["page_id"]]["text"] == want and rows[r["page_id"]]["n_chars"] == len(want)


# ------------------------------------------------------------------ quality
def pieces(text):
    """A text's symbols one by one."""
    words, out = (text or "").split(), ["^"] * (quality.ORDER - 1)
    for k, w in enumerate(words):
        w = ("\n" if k and w == words[k - 1] else w) + " "
        out += [w[i : i + 2] for i in range(0, len(w), 2)]
    return tuple(out) if words else ()


def slow_kneser_ney(texts, order):
    """An interpolated modified Kneser-Ney model of symbols in dictionaries: a function of (context, symbol)."""
    counts = [Counter() for _ in range(order)]
    for t in texts:
        for k in range(order - 1, len(t)):
            counts[order - 1][t[k - order + 1 : k + 1]] += 1  # t is a tuple
    for n in range(order - 2, -1, -1):
        for gram in counts[n + 1]:
            counts[n][gram[1:]] += 1
    floor, levels = 1 / (len(counts[0]) + 1), []
    for c in counts:
        n1, n2, n3, n4 = (sum(x == k for x in c.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        lower = {1: min(max(1 - 2 * y * n2 / max(n1, 1), 0.05), 0.95), 2: min(max(2 - 3 * y * n3 / max(n2, 1), 0.1), 1.9), 3: min(max(3 - 4 * y * n4 / max(n3, 1), 0.1), 2.9)}
        total, freed = Counter(), Counter()
        for gram, x in c.items():
            total[gram[:-1]] += x
            freed[gram[:-1]] += lower[min(x, 3)]
        levels.append((c, lower, total, freed))

    def p(context, symbol):
        value = floor
        for n, (c, lower, total, freed) in enumerate(levels):
            h = context[len(context) - n :]
            if h in total:
                x = c.get((*h, symbol), 0)
                value = (x - lower[min(x, 3)] if x else 0) / total[h] + freed[h] / total[h] * value
        return value

    return p


@pytest.mark.parametrize("fewest", [5, 10**9])
def test_perplexities_are_those_of_a_slow_kneser_ney(spark, sf_small, monkeypatch, fewest):
    monkeypatch.setattr(quality, "FEWEST", fewest)
    docs, labels = spark.read.parquet(f"{sf_small}/documents.parquet"), spark.read.parquet(f"{sf_small}/labels.parquet")
    rows, good = docs.select("doc_id", "lang", "text").collect(), {r["doc_id"] for r in labels.where("quality = 1").collect()}
    trusted = [r for r in rows if r["doc_id"] in good]
    n = Counter(r["lang"] for r in trusted)
    own = {g for g, k in n.items() if k >= fewest}
    assert bool(own) == (fewest == 5)
    models = {g: slow_kneser_ney([pieces(r["text"]) for r in trusted if g in ("", r["lang"])], quality.ORDER) for g in own | {""}}
    found = {r["doc_id"]: r["perplexity"] for r in quality.judged(docs, labels).collect()}
    assert sorted(found) == sorted(r["doc_id"] for r in rows)
    for r in rows[:60]:
        s, p = pieces(r["text"]), models[r["lang"] if r["lang"] in own else ""]
        logs = [math.log(p(s[k - quality.ORDER + 1 : k], s[k])) for k in range(quality.ORDER - 1, len(s))]
        assert found[r["doc_id"]] == (pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-9) if logs else None)


def test_probabilities_add_up_to_one():
    known, every, _ = quality.symbols_of([quality.stream("the cat sat on the mat and the dog sat on the log")])
    (_, numbers), = quality.windows(known, every)
    grams, counts = quality.distinct(known[numbers])
    pairs, before, tallies, level, n = None, None, [quality.tally(counts)], grams, counts
    while len(level) > 1:
        level, n = quality.distinct(level[1:])
        tallies.append(quality.tally(n))
        if len(level) == 2:
            pairs, before = level, n
    shard = quality.Shard(grams, counts, pairs, before, np.array(tallies[::-1]))
    symbols = np.unique(pairs[1])
    for k in range(0, grams.shape[1], 7):
        every = np.repeat(grams[:, [k]], len(symbols) + 1, axis=1)
        every[-1] = np.append(symbols, np.uint64(1))  # and one that is unknown
        assert shard.probabilities(every).sum() == pytest.approx(1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 0x10FFFF), min_size=6, max_size=6), min_size=1, max_size=30), st.integers(1, 5))
def test_ranks_order_rows_as_they_are(rows, repeat):
    rows = rows * repeat
    key, bits = quality.ranked(np.array(rows, np.uint32).T)
    order, new = quality.in_order(np.array(rows, np.uint32).T)
    assert int(key.max()).bit_length() <= bits and order.tolist() == sorted(range(len(rows)), key=lambda k: (rows[k], k)) and new.sum() == len(set(map(tuple, rows)))


def test_word_order_counts_and_layout_does_not(spark, sf_small):
    docs, labels = spark.read.parquet(f"{sf_small}/documents.parquet"), spark.read.parquet(f"{sf_small}/labels.parquet")
    plain = {r["doc_id"]: r["perplexity"] for r in quality.judged(docs, labels).collect()}
    spread = {r["doc_id"]: r["perplexity"] for r in quality.judged(docs.repartition(5, "doc_id"), labels).collect()}
    assert plain == pytest.approx(spread, rel=1e-9)
    turned = docs.withColumn("text", F.array_join(F.reverse(F.split("text", r"\s+")), " ")).join(labels.select("doc_id"), "doc_id", "left_anti")
    mixed = {r["doc_id"]: r["perplexity"] for r in quality.judged(docs.join(labels.select("doc_id"), "doc_id", "left_semi").unionByName(turned), labels).collect()}
    changed = [i for i in plain if plain[i] and mixed[i] and abs(plain[i] / mixed[i] - 1) > 1e-6]
    assert len(changed) > 50


def test_quality_on_held_out_labels(spark, sf_medium):
    docs, labels = spark.read.parquet(f"{sf_medium}/documents.parquet"), spark.read.parquet(f"{sf_medium}/labels.parquet")
    rows = quality.judged(docs, labels).join(labels, "doc_id").collect()
    good = [r["keep"] for r in rows if r["quality"] == 1]
    bad = [r["keep"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.2
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in quality.judged(docs, labels).where("keep").collect()}


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, None)], "doc_id bigint, quality int, toxic int")
    rows = quality.judged(odd, labels).collect()
    assert len(rows) == len(ODD) and all(not r["keep"] for r in rows if r["perplexity"] is None)
    assert quality.judged(none, labels).count() == 0
    assert quality.accepted(odd, labels.limit(0)).count() == sum(bool((t or "").split()) for _, t, _ in ODD)
    clash = odd.withColumnsRenamed({"mark": "m", "bucket": "keep"}).withColumn("i", F.lit(3)).withColumn("row", F.lit("r"))
    kept = quality.accepted(clash, labels)
    assert kept.columns == clash.columns and quality.accepted(none, labels).count() == 0 and set(r["row"] for r in kept.collect()) <= {"r"}


# ------------------------------------------------------------------ context mixing
def test_scores(docs, texts, odd, none):
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().translate(table)), None] for i, t in texts.items()}
    counts = Counter(w for i, words in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in words)
    n, v = sum(counts.values()), len(counts)
    rows = {r["doc_id"]: r for r in mixing.scores(docs).collect()}
    assert sorted(rows) == sorted(tokens)
    for i, words in tokens.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 7 == 2, len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
        assert r["score"] < 0 and r["bits_per_byte"] < 8 or len(words) == 1
    assert mixing.scores(odd).count() == len(ODD) and mixing.scores(none).count() == 0


def test_decisions_are_a_distribution():
    code = mixing.Code(np.arange(258, dtype=float))
    assert abs(sum(2.0 ** -int(n) for n in code.size) - 1) < 1e-12
    # with even votes each bit of a word costs one bit
    mixer = mixing.Mixer(mixing.Tables(), code, [])
    words = np.array([5, 9], np.uint64)
    spelling = mixing.Spelling(words, b"ab c", code)
    score = mixer.pair_scores(words, b"ab c", np.array([2, 0]), np.array([0, 1]))
    assert score[0] == pytest.approx(-np.log(2) * spelling.size, rel=1e-6) and (score[0] == score[1]).all()


def test_pair_scores_are_those_of_a_slow_model():
    """Bit by bit: every context's counts from all pairs, the pair's own left out in training texts, votes, gate, map."""
    draw = random.Random(6)
    letters, words = "abcde", sorted({"".join(draw.choice("abcde") for _ in range(draw.randint(1, 12))) for _ in range(150)} | {"abcdabcdab", "abcdabcdabc", "abcdabcd"})
    hashes = {w: int(mixing.hashes_of(w.encode(), False)[0]) for w in words}
    words.sort(key=hashes.get)
    spelled = " ".join(words).encode()
    vocabulary = mixing.vocabulary_of(spelled)
    end = int(np.flatnonzero(vocabulary == mixing._END)[0])
    spelled = b" ".join([w.encode() for w in words[:end]] + [b""] + [w.encode() for w in words[end:]])
    listed = [*words[:end], None, *words[end:]]
    pairs = sorted({(draw.randrange(6) ** 2, draw.randrange(len(listed))) for _ in range(500)})
    before, word = (np.array(x) for x in zip(*pairs))
    times, held = np.array([draw.choice((0, 1, 1, 1, 2, 5)) for _ in pairs]), np.array([draw.random() < 0.4 for _ in pairs])
    frequency = np.zeros(258)
    frequency[[*map(ord, letters), mixing.CLOSE, mixing.STOP]] = [50, 40, 30, 20, 10, 60, 5]
    code, tables = mixing.Code(frequency), mixing.Tables()
    tables.learn(vocabulary, spelled, np.array([draw.randrange(9) for _ in listed]), code)
    weight = np.random.default_rng(1).normal(0.2, 0.1, mixing.first_weights().shape)
    seen = np.random.default_rng(2).integers(0, 50, (2, len(code.size), mixing.VOTES)).astype(float)
    mixer = mixing.Mixer(tables, code, weight, seen)
    found = mixer.pair_scores(vocabulary, spelled, before, word, times, held)

    path = lambda w: [(s, int(code.node[k]), int(code.bit[k])) for s in ([mixing.STOP] if w is None else [*w.encode(), mixing.CLOSE]) for k in range(code.first[s], code.first[s] + code.size[s])]
    counts = Counter()
    for (b, w), t in zip(pairs, times):
        so_far = ()
        for _, _, bit in path(listed[w]):
            counts[b, so_far, bit] += int(t)
            so_far += (bit,)
    spellings = {k: s for k, s in enumerate(listed)}
    for kind in (0, 1):
        for n, ((b, w), t) in enumerate(zip(pairs, times)):
            if kind and not held[n]:
                continue
            one = mixing.Spelling(vocabulary[[w]], b"" if listed[w] is None else listed[w].encode(), code)
            total, so_far = 0.0, ()
            for d, (_, node, bit) in enumerate(path(spellings[w])):
                mine = 1 if not kind and t else 0
                n0, n1 = counts[b, so_far, 0] - mine * (1 - bit), counts[b, so_far, 1] - mine * bit
                votes = [math.log((tables.n[k][1][one.slots[k][d]] + 0.4) / (tables.n[k][0][one.slots[k][d]] + 0.4)) for k in range(5)] + [math.log((n1 + 0.4) / (n0 + 0.4))]
                level = lambda k: sum(int(tables.n[k][:, one.slots[k][d]].sum()) > m for m in (0, 2, 7, 31, 255))
                gate = level(4) * mixing.LEVELS + level(3)
                dot = sum(min(9, max(-9, v)) * x for v, x in zip(votes, weight[gate])) + weight[gate][-1]
                mapped = 1 / (1 + math.exp(-(np.arange(mixing.VOTES) - mixing.VOTES // 2)[int(np.clip(np.rint(dot * 2), -16, 16)) + 16] / 2))
                cell = int(np.clip(np.rint(dot * 2), -16, 16)) + 16
                zeros, ones = seen[0, node, cell] + 8 * (1 - mapped), seen[1, node, cell] + 8 * mapped
                p = 0.5 / (1 + math.exp(-dot)) + 0.5 * ones / (zeros + ones)
                total += math.log(p if bit else 1 - p)
                so_far += (bit,)
            assert found[kind, n] == pytest.approx(total, rel=2e-3, abs=2e-3), (kind, n, listed[w])


def test_contexts_have_room_and_counts_do_not_wrap():
    assert all(b >= a for a, b in zip(mixing.BITS, mixing.bits_for(0)))
    # four bytes: 447,000 contexts for 404,216 words of sf0.1
    assert 1 << mixing.bits_for(404_216)[3] >= 2 * 447_000 and mixing.bits_for(10**8)[3] > mixing.bits_for(10**6)[3] > mixing.bits_for(0)[3]
    # one word, three thousand million times in two blocks
    code = mixing.Code(np.ones(258))
    vocabulary = mixing.vocabulary_of(b" ab")
    spelled = b" ".join(b"" if h == mixing._END else b"ab" for h in vocabulary)
    tables = mixing.Tables()
    for _ in range(2):
        tables.learn(vocabulary, spelled, np.where(vocabulary == mixing._END, 0, 1_500_000_000).astype(np.int64), code)
    assert all(t.min() >= 0 and t.max() == 3_000_000_000 for t in tables.n[3:])


def test_pairs_of_neighbours_do_not_share_slots():
    # more contexts than a table of 2^21 slots holds apart: each is counted for itself
    rng = np.random.default_rng(1)
    befores, decisions = 6_000, 400
    before = np.repeat(np.arange(befores), decisions)
    rest = np.tile(rng.choice(2**32, decisions, replace=False).astype(np.uint32), befores)
    bit, times = rng.integers(0, 2, len(before)).astype(bool), rng.integers(0, 5, len(before))
    zeros, ones = mixing.pair_counts(rest, before, bit, times)
    assert (zeros == times * ~bit).all() and (ones == times * bit).all()
    # all that follows a word is in one run and one shard
    group = np.sort(rng.integers(0, 9, 20_000))
    runs = [group[r] for r in mixing.pair_runs(group, np.full(len(group), 30))]
    assert len(np.concatenate(runs)) == len(group) and all(a[-1] < b[0] for a, b in zip(runs, runs[1:]))
    h = rng.integers(0, 2**63, 100).astype(np.uint64)
    assert (mixing.shard_of(h, 7) == mixing.shard_of(h[::-1], 7)[::-1]).all()


def test_weights_are_fitted_to_a_share_of_the_words_before(docs, texts, monkeypatch):
    given, sums = [], mixing.fitted

    def fitted(pairs, tables, code):
        weight, seen = sums(pairs, tables, code)
        rows = [r.asDict() for r in pairs.collect()]
        given.append((sum(int(mixing.unpacked(r)[3].sum()) for r in rows), sum(int(mixing.fit_part(r)[3].sum()) for r in rows), tables.n[0].sum(), seen.sum()))
        return weight, seen

    monkeypatch.setattr(mixing, "fitted", fitted)
    mixing.scores(docs).collect()
    # every training token is in a pair; of chosen words before every decision that follows is in the map's sums, as often as it comes
    (times, chosen, decisions, seen), = given
    tokens = [len(re.findall(rb"[^\x20\x09-\x0D]+", t.encode())) + 1 for i, t in texts.items() if not mixing.is_held_out(i)]
    assert times == sum(tokens) and 0.2 * times < mixing.FIT * chosen < 5 * times and 0.2 * decisions < mixing.FIT * seen < 5 * decisions


def test_weights_are_fitted_to_every_training_pair(docs, monkeypatch):
    given, sums = [], mixing.fitted

    def fitted(pairs, tables, code):
        weight, seen = sums(pairs, tables, code)
        rows = [r.asDict() for r in pairs.collect()]
        given.append((sum(int(mixing.unpacked(r)[3].sum()) for r in rows), sum(int(mixing.fit_part(r)[3].sum()) for r in rows), int(tables.n[0].sum()), seen.sum()))
        return weight, seen

    monkeypatch.setattr(mixing, "fitted", fitted)
    mixing.scores(docs).collect()
    (times, summed, decisions, seen), = given
    assert summed == times and seen == decisions


def test_fit_sums_are_those_of_every_decision():
    """Decision by decision of every pair, with its own occurrence left out of all counts."""
    draw = random.Random(8)
    words = sorted({"".join(draw.choice("abcd") for _ in range(draw.randint(1, 11))).encode() for _ in range(120)}, key=lambda w: int(mixing.hashes_of(w, False)[0]))
    spelled = b" ".join(words)
    vocabulary = mixing.vocabulary_of(spelled)
    spelled = b" ".join(b"" if h == mixing._END else words[k - int(h > mixing._END)] for k, h in enumerate(vocabulary))
    pairs = sorted({(draw.randrange(5) ** 2, draw.randrange(len(vocabulary))) for _ in range(300)})
    before, word = (np.array(x) for x in zip(*pairs))
    times = np.array([draw.choice((1, 1, 1, 2, 7)) for _ in pairs])
    frequency = np.zeros(258)
    frequency[[*b"abcd", mixing.CLOSE, mixing.STOP]] = [50, 40, 30, 20, 60, 5]
    code, tables = mixing.Code(frequency), mixing.Tables()
    tables.learn(vocabulary, spelled, np.bincount(word, weights=times, minlength=len(vocabulary)).astype(np.int64), code)
    weight = np.random.default_rng(3).normal(0.2, 0.1, mixing.first_weights().shape)
    found = mixing.fit_sums(mixing.LeftOut(tables), code, weight, spelled, before, word, times)

    spelling = mixing.Spelling(vocabulary, spelled, code)
    index = mixing.spread(spelling.first[word], spelling.size[word])
    bit, each = spelling.bit[index], np.repeat(times, spelling.size[word])
    counts = [(n[0][s[index]], n[1][s[index]]) for n, s in zip(tables.n, spelling.slots)]
    counts.append(mixing.pair_counts(spelling.rest[index], np.repeat(before, spelling.size[word]), bit, each))
    counts = [(a - (bit == 0), b - (bit == 1)) for a, b in counts]
    x = np.stack([*(np.clip(np.log((b + 0.4) / (a + 0.4)), -9, 9) for a, b in counts), np.ones(len(bit))], axis=1)
    gate = mixing.level(sum(counts[4])).astype(int) * mixing.LEVELS + mixing.level(sum(counts[3]))
    p = 1 / (1 + np.exp(-(weight[gate] * x).sum(axis=1)))
    gradient, curve = np.zeros_like(weight), np.zeros((*weight.shape, weight.shape[1]))
    np.add.at(gradient, gate, (each * (bit - p))[:, None] * x)
    np.add.at(curve, gate, (each * p * (1 - p))[:, None, None] * x[:, :, None] * x[:, None, :])
    assert len(set(gate)) > 5 and found[0] == pytest.approx(gradient, rel=1e-4, abs=1e-3) and found[1] == pytest.approx(curve, rel=1e-4, abs=1e-3)
    assert found[2].sum() == each.sum() and (found[2].sum(axis=2) == [[each[(bit == b) & (spelling.node[index] == n)].sum() for n in range(len(code.size))] for b in (0, 1)]).all()


def test_what_follows_a_frequent_word_is_worked_on_in_parts(monkeypatch):
    draw = random.Random(9)
    words = sorted({"".join(draw.choice("abc") for _ in range(draw.randint(1, 9))).encode() for _ in range(900)}, key=lambda w: int(mixing.hashes_of(w, False)[0]))
    vocabulary = mixing.vocabulary_of(b" ".join(words))
    spelled = b" ".join(b"" if h == mixing._END else words[k - int(h > mixing._END)] for k, h in enumerate(vocabulary))
    pairs = sorted({(b, w) for b in range(4) for w in range(len(vocabulary)) if b == 2 or draw.random() < 0.02})
    before, word = (np.array(x) for x in zip(*pairs))
    times = np.array([draw.choice((0, 1, 1, 2, 7)) for _ in pairs])
    frequency = np.zeros(258)
    frequency[[*b"abc", mixing.CLOSE, mixing.STOP]] = [50, 40, 30, 60, 5]
    code, tables = mixing.Code(frequency), mixing.Tables()
    tables.learn(vocabulary, spelled, np.bincount(word, weights=times, minlength=len(vocabulary)).astype(np.int64), code)
    mine = times > 0

    def found():
        scores = mixing.Mixer(tables, code).pair_scores(vocabulary, spelled, before, word, times)
        return scores, *mixing.fit_sums(mixing.LeftOut(tables), code, mixing.first_weights(), spelled, before[mine], word[mine], times[mine])

    whole, sizes, runs = found(), [], mixing.counted_runs

    def counted_runs(*given):
        for some, index, n0, n1 in runs(*given):
            sizes.append(len(index))
            yield some, index, n0, n1

    monkeypatch.setattr(mixing, "CHUNK", 500)
    monkeypatch.setattr(mixing, "counted_runs", counted_runs)
    for a, b in zip(whole, found()):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9)
    assert sum(sizes) > 10_000 and max(sizes) < 2_000


def test_files_of_finished_shuffles_are_removed(spark, docs, monkeypatch):
    """Those of words and pairs are; one of the small sums may be held by the session."""

    def shuffles():
        blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
        return {name.split("_")[1] for k in range(blocks.size()) if (name := blocks.apply(k).toString()).startswith("shuffle_")}

    left, before, sweep = [], shuffles(), mixing.swept

    def swept(session):
        sweep(session)
        until = time.time() + 20
        while len(more := shuffles() - before) > 1 and time.time() < until:
            time.sleep(0.2)
        left.append(len(more))

    monkeypatch.setattr(mixing, "swept", swept)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    assert mixing.scores(docs).count() == docs.count() and left[0] <= 1 and spark.conf.get(name, None) == was


def test_documents_that_occur_twice_score_higher(spark, docs):
    """Leaving out a pair's own count tells what has been seen elsewhere from what has not."""
    doubled = docs.where("doc_id % 9 = 0").withColumn("doc_id", F.col("doc_id") + 100_000)
    rows = {r["doc_id"]: r for r in mixing.scores(docs.unionByName(doubled)).where("not held_out and n_tokens > 50").collect()}
    once = {r["doc_id"]: r for r in mixing.scores(docs).where("not held_out and n_tokens > 50").collect()}
    gain = lambda i: (rows[i]["score"] - once[i]["score"]) / rows[i]["n_tokens"]
    twice, single = [gain(i) for i in rows if i + 100_000 in rows and i in once], [gain(i) for i in rows if i in once and i % 9]
    assert len(twice) > 5 and np.median(twice) > np.quantile(single, 0.9)


def test_scores_do_not_depend_on_shards(docs, monkeypatch):
    def run():
        return {r["doc_id"]: r["score"] for r in mixing.scores(docs).collect()}

    whole = run()
    monkeypatch.setattr(mixing, "partitions", lambda spark: 1)
    assert run() == pytest.approx(whole, rel=1e-4)


def test_scores_do_not_depend_on_the_layout(docs):
    """Blocks of a task change with the files; the model and so the scores don't."""
    one = {r["doc_id"]: r["score"] for r in mixing.scores(docs.coalesce(1)).collect()}
    seven = {r["doc_id"]: r["score"] for r in mixing.scores(docs.repartition(7, "doc_id")).collect()}
    assert one == pytest.approx(seven, rel=1e-5)


# ------------------------------------------------------------------ personal data
def luhn(s):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(s)))) % 10 == 0


def base_spans(text):
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, rule in rules.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def holds(rows, given_):
    left = sorted((hashlib.sha256(",".join(base_spans(t or "")).encode()).hexdigest(), -1 if i is None else i) for i, t in given_)
    assert sorted((r["base_sha256"], -1 if r["doc_id"] is None else r["doc_id"]) for r in rows) == left
    for r in rows:
        kinds = Counter(s.split(":")[0] for s in filter(None, r["spans"].split(",")))
        assert all(kinds[k] >= r[f"n_{k}"] for k in privacy.KINDS)


def test_base_spans(spark, sf_medium, odd, none):
    frame = spark.read.parquet(f"{sf_medium}/documents.parquet")
    holds(privacy.digest(frame).collect(), [(r["doc_id"], r["text"]) for r in frame.collect()])
    holds(privacy.digest(odd).collect(), [x[:2] for x in ODD])
    assert privacy.digest(none).count() == 0


def test_base_spans_of_random_signs(spark):
    draw = random.Random(5)
    given_ = [(k, "".join(draw.choice(signs) for _ in range(draw.randint(0, 70)))) for signs in ("a1.@-_ é", "0123.", "01 -", "+1() .-2", "4 -1") for k in range(300)]
    given_ += [(1, "a@" + "b." * 20_000 + "c"), (2, "1 " * 30_000), (3, "9" * 50_000), (4, "a" * 50_000 + "@x.de"), (5, "+1" + "." * 30_000)]
    given_ = [(k, t) for k, (_, t) in enumerate(given_)]
    holds(privacy.digest(spark.createDataFrame(given_, "doc_id bigint, text string")).collect(), given_)


MISSED = {  # what the rules miss, and look-alikes with nothing in them
    "call me at 743-555-3824 now": ["phone"], "phone (743) 555-3824 please": ["phone"], "tel 0743/5553824": ["phone"], "mail joe (at) mail7.example.com today": ["email"],
    "joe [at] mail7 [dot] example [dot] com": ["email"], "joe at mail dot com": ["email"], "x@b\u00fccher.de wrote": ["email"], "host 10[.]20[.]30[.]40 was": ["ip"],
    "card 4111.1111.1111.1111 here": ["card"], "it is 3782 822463 10005": ["card"],
    "on 2024-05-17 we met": [], "version 10.4.22.1031 is out": [], "300[.]400[.]1[.]2": [], "number 4111.1111.1111.1112 here": [], "order 0048151677 came": [], "isbn 978-3-16-148410-0": [],
    "we met (at) home. 12": [], "17.05.2024": [], "1999-2004": [], "1 250 000": [], "come at noon. We": [], "look at it": [], "3.14159265": [],
}


def test_trees_add_what_the_rules_miss_and_no_look_alikes(spark):
    rows = privacy.personal_data(spark.createDataFrame([(k, t) for k, t in enumerate(MISSED)], "doc_id bigint, text string")).collect()
    found = {list(MISSED)[r["doc_id"]]: [privacy.KINDS[x["o"] - 1] for x in r["spans"] if not x["base"]] for r in rows}
    assert found == MISSED


def test_precision_and_recall_on_damaged_spans(spark, sf_medium):
    """The phones and addresses of the documents, as no rule finds them, are found again in other documents' texts, and nothing else is added."""
    docs = spark.read.parquet(f"{sf_medium}/documents.parquet").select("doc_id", "text")
    damaged = docs.withColumn("text", F.regexp_replace(F.regexp_replace("text", r"\+1 \(", "("), r"@(mail[0-9])\.example\.", " (at) $1.example (dot) "))
    before = {r["doc_id"]: [s for s in base_spans(r["text"]) if s.startswith(("phone", "email"))] for r in docs.collect()}
    rows = {r["doc_id"]: r for r in privacy.personal_data(damaged).collect()}
    hits = sum(len([x for x in rows[i]["spans"] if not x["base"]]) >= len(s) for i, s in before.items() if s)
    wrong = sum(any(not x["base"] for x in rows[i]["spans"]) for i, s in before.items() if not s)
    assert hits >= 0.95 * sum(map(bool, before.values())) > 5 and wrong == 0


def test_boosting_and_thresholds():
    x = np.array([[a, b] for a in range(4) for b in range(4)])
    pos, neg = np.where(x[:, 0] + x[:, 1] > 3, 50.0, 1.0), np.where(x[:, 0] + x[:, 1] > 3, 1.0, 50.0)
    trees = privacy.boosted(x, pos, neg)
    score = sum(privacy.values_of(t, x) for t in trees)
    assert score[pos > neg].min() > score[pos < neg].max()
    # equal scores stand or fall together; too few or too many false ones give no threshold
    assert privacy.calibrated(np.array([2.0, 1.0, 1.0]), np.array([30.0, 30.0, 0.0]), np.array([0.0, 0.0, 9.0])) == 2.0
    assert privacy.calibrated(np.array([1.0]), np.array([19.0]), np.array([0.0])) == math.inf == privacy.calibrated(np.array([1.0]), np.array([50.0]), np.array([5.0]))


def test_redaction(odd, none):
    rows = {(r["doc_id"], r["n_chars"]): r for r in privacy.redacted(odd).collect()}
    text = next(r["text"] for k, r in rows.items() if k[0] == 10)
    assert text.startswith("[EMAIL]. [IP] 1.2.3.400, [CARD], [PHONE], 999")
    assert privacy.redacted(odd).columns == odd.columns and len(privacy.redacted(odd).collect()) == len(ODD)
    clash = odd.withColumnsRenamed({"bucket": "cuts", "mark": "spans"}).withColumn("row", F.lit("row")).withColumn("body", F.lit(1)).withColumn("__d", F.lit(2))
    out = privacy.redacted(clash)
    assert out.columns == clash.columns and {(r["cuts"], r["spans"], r["row"], r["body"], r["__d"]) for r in out.collect()} == {("clash", "clash", "row", 1, 2)}
    assert privacy.redacted(none).count() == 0 and privacy.redacted(none).schema.names == none.columns


# ------------------------------------------------------------------ near-duplicates
def brute_components(rows, k, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w)} - {()} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k_, (i, _) in enumerate(rows):
        least[find(k_)] = min(i, least.get(find(k_), i))
    return {i: (len(sets[k_]), least[find(k_)]) for k_, (i, _) in enumerate(rows)}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, sf_medium, k):
    frame = spark.read.parquet(f"{sf_medium}/documents.parquet").where("doc_id < 400")
    rows = [(r["doc_id"], r["text"]) for r in frame.orderBy("doc_id").collect()]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame, words=k).collect()}
    assert found == brute_components(rows, k)


def test_near_duplicates_in_chains(spark, monkeypatch):
    """A chain of edits whose ends are unlike, in buckets of several blocks, beside rows near the limit."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    draw, rows = random.Random(2), []
    words = [f"w{draw.randrange(10**6)}" for _ in range(60)]
    for k in range(60):
        rows.append((k, " ".join(words)))
        words[draw.randrange(60)] = f"n{k}"
    base = [f"b{k}" for k in range(80)]
    for k in range(60, 120):
        other = list(base)
        for _ in range(draw.randint(0, 9)):
            other[draw.randrange(80)] = f"x{draw.randrange(10**6)}"
        rows.append((k, " ".join(other)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame, words=2).collect()}
    assert found == brute_components(rows, 2)


def test_near_duplicates_of_odd_rows(odd, none):
    rows = neardup.near_duplicates(odd, words=2).collect()
    assert len(rows) == len(ODD) and neardup.near_duplicates(none).count() == 0
    assert all(r["component_id"] == r["doc_id"] and r["n_shingles"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    once = neardup.deduplicated(odd)
    assert once.columns == odd.columns and sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in once.collect()) == [-1, 1, 2, 3, 4, 5, 6, 7, 9, 10]


def test_components(spark):
    draw = random.Random(1)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(100)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert found == {x: find(x) for a, b in links if a != b for x in (a, b)}


# ------------------------------------------------------------------ decontamination
def test_contaminated(spark, sf_medium):
    docs, items = spark.read.parquet(f"{sf_medium}/documents.parquet"), spark.read.parquet(f"{sf_medium}/benchmark.parquet")
    runs = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)}
    bench = {r["item_id"]: runs(r["text"]) for r in items.collect()}
    want = {(r["doc_id"], i) for r in docs.collect() for i, s in bench.items() if len(s & runs(r["text"])) >= 0.95 * len(s)}
    found = decontamination.contaminated(docs, items)
    assert want and {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} - {r["doc_id"] for r in decontamination.decontaminated(docs, items).select("doc_id").collect()} == {d for d, _ in want}


def test_wand_finds_what_a_full_scan_finds():
    draw = random.Random(3)
    words = [f"t{k}" for k in range(60)]
    items = [(k, " ".join(draw.choices(words, k=draw.randint(3, 30)))) for k in range(100)]
    frequency = Counter(w for _, t in items for w in set(decontamination.hashed(t).tolist()))
    weight = {w: math.log(1 + (100 - n + 0.5) / (n + 0.5)) for w, n in frequency.items()}
    shard = decontamination.Shard(items, weight, 16.0)
    for _ in range(200):
        terms = np.unique(shard.term_of(decontamination.hashed(" ".join(draw.choices(words, k=20)))))
        scores = Counter()
        for t in terms.tolist():
            if t < len(shard.postings):
                for item, x in shard.postings[t]:
                    scores[item] += x
        found = dict(shard.wand(terms.tolist(), 0.5))
        assert set(found) == {k for k, s in scores.items() if s >= 0.5}


def brute_contamination(texts, items):
    """(document, item) and the best (score, overlaps) over all passages, by BM25 over every item and plain sets of five words."""
    split = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), re.sub(r"[!-/:-@\\[-`{-~]", " ", t or "")).split()
    words = {i: split(t) for i, t in items.items() if split(t)}
    n, average = len(words), sum(map(len, words.values())) / len(words)
    frequency = Counter(w for x in words.values() for w in set(x))
    order = sorted(words, key=lambda i: (len(words[i]), i))
    span = {i: max(len(words[j]) for j in order[k - k % decontamination.BLOCK :][: decontamination.BLOCK]) for k, i in enumerate(order)}
    runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    found = {}
    for d, text in texts.items():
        own = split(text)
        for i, w in words.items():
            if not set(w) & set(own):
                continue
            impact = {t: math.log(1 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / average)) for t, c in Counter(w).items()}
            k, cells, whole = min(5, len(w)), -(-(span[i] - 1) // 16) + 1, sum(impact.values())
            cut = len(split(items[i][: decontamination.answer_begins(items[i])]))
            every = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            asks = max(0, cut - k + 1) if cut else len(every)
            for begin in range(0, len(own), 16):
                part = own[begin : begin + 16 * cells]
                score = sum(impact[t] for t in set(part) & set(impact)) / whole
                if score >= 0.5 - 1e-9:
                    held = runs(part, k)
                    q, a = (len(x & held) / len(x) if x else 1.0 for x in (set(every[:asks]), set(every[asks:])))
                    if q >= 0.8 and a >= 0.8:
                        found[d, i] = max(found.get((d, i), (0, 0, 0)), (score, q, a))
    return found


def test_contaminated_against_brute_force(spark):
    """Whole, changed, cut, split and padded copies of items at the limits of both thresholds."""
    draw = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    items = {k: " ".join(draw.choices(vocabulary, k=draw.randint(3, 40))) + draw.choice(["? ", ". "]) + " ".join(draw.choices(vocabulary, k=draw.randint(0, 12))) for k in range(60)}
    texts = {}
    for d in range(150):
        w = items[draw.randrange(60)].split()
        for _ in range(draw.choice((0, 0, 1, 1, 2, 4))):
            w[draw.randrange(len(w))] = draw.choice(vocabulary)
        w = w[draw.choice((0, 0, 0, 2, 6)) :]
        texts[d] = " ".join(draw.choices(vocabulary, k=draw.randint(0, 60)) + w + draw.choices(vocabulary, k=draw.randint(0, 60)))
    want = brute_contamination(texts, items)
    rows = decontamination.contaminated(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), spark.createDataFrame(list(items.items()), "item_id bigint, text string")).collect()
    found = {(r["doc_id"], r["item_id"]): (r["score"], r["question_overlap"], r["answer_overlap"]) for r in rows}
    assert len(want) > 60 and sorted(found) == sorted(want)
    for k, v in want.items():
        assert found[k] == pytest.approx(v, abs=1e-6)


def test_contaminated_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "one two three four"), (2, None), (3, ""), (4, "never seen at all by anyone"), (5, "one")], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(odd, items).collect()} >= {(5, 1), (4, 5), (5, 5)}
    assert decontamination.contaminated(odd, items.limit(0)).count() == 0 and decontamination.contaminated(none, items).count() == 0
    assert decontamination.decontaminated(odd, items.limit(0)).count() == len(ODD)


# ------------------------------------------------------------------ archives
def test_archives(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet").unionByName(spark.read.parquet(f"{sf_small}/pages.parquet").selectExpr("page_id + 100000 as page_id", "url", "html").where("page_id % 3 = 0"))
    rows = archives.archive(pages).collect()
    want, first = [], {}
    given_ = sorted((r["page_id"], (r["html"] or "").encode()) for r in pages.collect())
    for i, html in given_:
        to = first.setdefault(html, i) if len(html) >= 100 else i
        want.append((i, len(html), hashlib.sha256(html).hexdigest(), "response" if to == i else "revisit", None if to == i else to))
    assert sorted(map(tuple, rows)) == want


def test_archives_of_odd_pages(spark):
    rows = [(1, None, None), (2, "http://a b\n", ""), (3, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", "é" * 50), (6, "u", "é" * 50), (6, "u", "é" * 50), (7, "u", "\r\n\r\n" * 50_000)]
    found = archives.archive(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"] or 0) for r in found) == [(1, "response", 0), (2, "response", 0), (3, "response", 0), (4, "response", 0), (5, "response", 0), (6, "revisit", 5), (6, "revisit", 5), (7, "response", 0)]
    assert archives.archive(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_archive_begins_with_its_dictionary():
    data = archives.head_frame(b"abc") + b""
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and list(archives.Archive(io.BytesIO(data))) == []


def test_pair_scores_are_exchanged_as_they_come(spark):
    """Lines of pairs leave a task one by one: no sum by block holds them beside the workers' arrays."""
    docs = spark.createDataFrame([(k, f"a b c d{k}") for k in range(20)], "doc_id bigint, text string")
    blocks = mixing.written(docs.mapInArrow(mixing._blocks, mixing.BLOCK_SCHEMA), "blocks")
    with mixing.rows_by_one(spark):
        plan = mixing._scores_of(blocks)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan


def test_numbers_that_are_sent_come_back():
    draw = np.random.default_rng(4)
    for n in (0, 1, 1000):
        for a in (draw.integers(0, 2**63, n).astype(np.uint64), draw.integers(0, 2**32, n).astype(np.uint32), draw.normal(size=n).astype(np.float32), draw.integers(-9, 9, n)):
            assert (mixing.unplaned(mixing.planes(a), a.dtype.type) == a).all()
        assert (mixing.unstepped(mixing.steps(a % 1000)) == a % 1000).all()


def test_blocks_get_the_scores_that_their_texts_need(spark):
    """A pair's score as of a training text goes to blocks that have it in one, and that as of a held-out text likewise."""
    docs = [(k, f"a b c d{k % 5} e f{k}") for k in range(40)]
    pairs = [set(), set()]
    for k, text in docs:
        words = [*text.split(), None]
        pairs[mixing.is_held_out(k)].update(zip(["", *words], words))
    blocks = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1).mapInArrow(mixing._blocks, mixing.BLOCK_SCHEMA)
    lines = blocks.select("block", "ids", "sizes", "tokens", "spelled").mapInArrow(mixing._pair_lines(3), "shard bigint, block bigint, data binary")
    table = lines.groupBy("shard").applyInArrow(mixing._pair_sums, mixing.PAIR_SCHEMA).toArrow()
    assert sum(table["tokens"].to_pylist()) == sum(len(t.split()) + 1 for k, t in docs if not mixing.is_held_out(k))

    class Shared:
        value = mixing.Mixer(mixing.Tables(), mixing.Code(np.ones(258)))

    unpack, sent = zstandard.ZstdDecompressor(), [0, 0]
    for batch in mixing._pair_scores(Shared)(iter(table.to_batches(1))):
        for kind, name in enumerate(("spelt", "held")):
            scores = mixing.unplaned(unpack.decompress(batch[name][0].as_py()), np.float32)
            sent[kind] += len(scores)
            assert (scores < 0).all()
    assert sent == [len(pairs[0]), len(pairs[1])] and 0 < sent[1] < sent[0]


def test_all_shards_are_passed_over_once(docs, monkeypatch):
    """The first shards only say where the step over all pairs begins."""
    walks, given, lines, sums = [], [], mixing._fit_lines, mixing.fitted

    def fit_lines(shared, code, weight):
        walks.append(weight)
        return lines(shared, code, weight)

    def fitted(pairs, tables, code):
        weight, seen = sums(pairs, tables, code)
        given.append((int(tables.n[0].sum()), seen.sum(), weight))
        return weight, seen

    whole = {r["doc_id"]: r["score"] for r in mixing.scores(docs).collect()}
    monkeypatch.setattr(mixing, "START", 1)
    monkeypatch.setattr(mixing, "_fit_lines", fit_lines)
    monkeypatch.setattr(mixing, "fitted", fitted)
    found = {r["doc_id"]: r["score"] for r in mixing.scores(docs).collect()}
    (decisions, seen, weight), = given
    assert len(walks) == mixing.ROUNDS + 1 and seen == decisions and (weight != walks[-1]).any()
    assert sum(found.values()) == pytest.approx(sum(whole.values()), rel=0.01)


def test_what_pairs_have_in_common_is_worked_on_once():
    draw = random.Random(10)
    words = sorted({"".join(draw.choice("ab\0c") for _ in range(draw.randint(1, 12))).encode() for _ in range(300)}, key=lambda w: int(mixing.hashes_of(w, False)[0]))
    vocabulary = mixing.vocabulary_of(b" ".join(words))
    spelled = b" ".join(b"" if h == mixing._END else words[k - int(h > mixing._END)] for k, h in enumerate(vocabulary))
    pairs = sorted({(b, w) for b in range(6) for w in range(len(vocabulary)) if b == 2 or draw.random() < 0.2})
    before, word = (np.array(x) for x in zip(*pairs))
    times, code = np.array([draw.choice((0, 1, 1, 3)) for _ in pairs]), mixing.Code(np.ones(258))
    known = mixing.Words(vocabulary, spelled, code, word)
    order, last, depth = known.followed(before, times > 1)
    rest, bit = np.empty(known.total, np.uint32), np.empty(known.total, np.uint8)
    for here, spelling in known.spellings(code, mixing.BITS):
        rest[here], bit[here] = spelling.rest, spelling.bit
    found = []
    for shared in (True, False):
        paths = known.paths(order, before, last, shared)
        zeros, ones = mixing.pair_counts(rest[paths.index], paths.before, bit[paths.index], paths.times(times))
        found.append((len(paths.index), paths.times(times).sum(), paths.sums(zeros + 3 * ones + bit[paths.index])))
    assert found[1][0] == depth.sum() and found[0][0] < 0.7 * found[1][0] and found[0][1] == found[1][1] and (found[0][2] == found[1][2]).all()
