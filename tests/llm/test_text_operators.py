"""The operators against brute force, and on odd rows."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, decontam, html_text, lm_score, pieces, pii, quality_forest, simhash, suffix_dedup, token_counts, toxicity, words

SF = "/root/testdata/sf0.001"
LONG = "word and more " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, an empty and a long text, repeats, and columns named like those of the operators."""
    rows = [(1, "the one the two"), (2, None), (3, ""), (None, "text without id"), (None, None), (5, LONG), (1, "the one the two"), (6, " \n\t "), (7, "é😀 中文 +1 (974) 555-3436 x")]
    return spark.createDataFrame([(i, t, None, 9, "h", 1.5, "r", 7) for i, t in rows], "doc_id long, text string, lang string, n_chars long, hits string, score double, row string, fp long")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (3, 0, 1), (5, 1, 0), (6, None, None), (None, 1, 1), (999, 0, 1)], "doc_id long, quality int, toxic int")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1 personal data

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (c > "4") for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) < 256 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_like_plain_patterns(spark):
    r = random.Random(3)
    parts = ["a.b@c.d", "x@y", ".@", "a@b.c@d.e.f", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0012.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1111", "41111111111111111", "+1 (974) 555-3436", "+12 34", " ", "  ", "\n", "é😀", "-", ".", "", "@", "a..b@c-d.e..f"]
    rows = [(i, "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 12)))) for i in range(300)]
    rows += [(1001, None), (1002, "1 " * 9000), (1003, "a@b" + ".c" * 9000), (1004, "1" * 20000), (1005, "a" * 50000 + "@"), (1006, "x@y.z 1.2.3.4 +1 (974) 555-3436 " * 300)]
    found = by_id(pii.digest(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]))
    for i, t in rows:
        want = base_spans(t)
        assert found[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        assert set(filter(None, want.split(","))) <= set(found[i]["spans"].split(","))
        assert sum(found[i][f"n_{k}"] for k in pii.KINDS) == len(list(filter(None, want.split(","))))


def test_labelers_add_loose_spans_and_reject_signs_against(spark):
    texts = ["call (212) 555-1234 today", "mail bob (at) site (dot) com", "card 3782 822463 10005", "version 112-555-1234", "plain 5", "a@b.com"] + ["phone +1 (974) 555-3436"] * 20
    found = by_id(pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]))
    assert found[0]["spans"] == "phone:5:19" and found[1]["spans"] == "email:5:28" and found[2]["spans"] == "card:5:22"
    assert found[3]["n_added"] == found[4]["n_added"] == found[5]["n_added"] == 0


def test_reliabilities_tell_good_from_bad_labelers():
    r = random.Random(1)
    table = Counter()
    for _ in range(5000):
        true = r.random() < 0.4
        vote = lambda p, true=true: (1 if true else -1) if r.random() < p else (-1 if true else 1)
        table[vote(0.95), vote(0.9), vote(0.85), vote(0.8), vote(0.55)] += 1
    share, probs, _ = pii.reliabilities(sorted(table.items()))
    assert abs(share - 0.4) < 0.05 and [round(p[1][0], 1) for p in probs[:4]] == [0.9, 0.9, 0.8, 0.8] or probs[0][1][0] > probs[4][1][0] + 0.2


def test_long_texts_take_time_in_proportion(spark):
    """60000 spans in a megabyte, within seconds; places and redaction like plain patterns."""
    import time

    unit = "x@y.zz and 4111 1111 1111 1111, "
    docs = spark.createDataFrame([(1, unit * 30_000, 0), (2, unit * 3, 0)], "doc_id long, text string, n_chars int")
    began = time.time()
    found, clean = by_id(pii.digest(docs, ["doc_id"])), by_id(pii.redacted(docs))
    took = time.time() - began
    for i, n in ((1, 30_000), (2, 3)):
        assert found[i]["base_sha256"] == hashlib.sha256(base_spans(unit * n).encode()).hexdigest() and found[i]["n_email"] == found[i]["n_card"] == n
        assert clean[i]["text"] == "[EMAIL] and [CARD], " * n and clean[i]["n_chars"] == 20 * n
    assert took < 30, took


def plain_redacted(text, spans):
    out, at = "", 0
    for a, b, k in sorted(spans, key=lambda s: (s[0], s[1], pii.KINDS.index(s[2]))):
        if a >= at:
            out += text[at:a] + f"[{k.upper()}]"
        at = max(at, b)
    return out + text[at:]


def test_redaction_like_plain_spans(spark, monkeypatch):
    """Overlaps of kinds, chunks and blocks of every size."""
    monkeypatch.setattr(pii, "CHUNK", 7)
    monkeypatch.setattr(pii, "BLOCK", 3)
    r = random.Random(12)
    parts = ["+1 4111 1111 1111 1111", "+4111111111111111@a.b", "1.2.3.4@c.dd", "(212) 555-1234", "a@b.c", "4111-1111-1111-1111", "1::2", "😀é", " ", "\n", "bob (at) site (dot) com", "37828224631 0005", "3782 822463 10005"]
    rows = [(i, "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 14)))) for i in range(200)] + [(900, None), (901, "")]
    docs = spark.createDataFrame([(i, t, 5, "keep") for i, t in rows], "doc_id long, text string, n_chars long, spans string")
    found, clean = by_id(pii.digest(docs, ["doc_id"])), by_id(pii.redacted(docs))
    assert sum(x["n_added"] for x in found.values()) > 50
    for i, t in rows:
        spans = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in found[i]["spans"].split(",") if x)]
        assert clean[i]["text"] == (t if t is None else plain_redacted(t, spans)) and clean[i]["spans"] == "keep", (t, spans)
    empty = docs.limit(0)
    assert pii.digest(empty, ["doc_id"]).count() == pii.redacted(empty).count() == 0


def plain_reliabilities(table, rounds=50):
    """Dawid and Skene row by row, candidates written out."""
    rows = [v for v, n in table for _ in range(n)]
    post = [1 / (1 + np.exp(1.0 - 1.5 * sum(v))) for v in rows]
    hope = {-1: (0.1, 1.0), 0: (0.5, 0.5), 1: (1.0, 0.4)}
    for _ in range(rounds):
        share = (sum(post) + 1) / (len(rows) + 2)
        like = lambda k, x, side: (sum((p, 1 - p)[side] for p, v in zip(post, rows) if v[k] == x) + 4 * hope[x][side]) / (sum((p, 1 - p)[side] for p in post) + 4 * sum(h[side] for h in hope.values()))
        known = {(k, x, side): like(k, x, side) for k in range(5) for x in (-1, 0, 1) for side in (0, 1)}
        true, false = ([w * np.prod([known[k, x, side] for k, x in enumerate(v)]) for v in rows] for side, w in ((0, share), (1, 1 - share)))
        post = [a / (a + b) for a, b in zip(true, false)]
    return share, dict(zip(rows, post))


def test_reliabilities_like_plain_rounds():
    r = random.Random(2)
    table = sorted(Counter(tuple(r.choice((-1, 0, 1)) for _ in range(5)) for _ in range(60)).items())
    share, _, post = pii.reliabilities(table)
    want, plain = plain_reliabilities(table)
    assert share == pytest.approx(want, rel=1e-9) and all(p == pytest.approx(plain[v], rel=1e-6) for (v, _), p in zip(table, post))


def test_redaction_keeps_columns(spark, odd):
    out = pii.redacted(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert by_id(out)[7]["text"] == "é😀 中文 [PHONE] x" and by_id(out)[7]["n_chars"] == 15 and by_id(out)[7]["row"] == "r"


# 2 main text


def test_main_text():
    page = "<html><head><title>T</title><script>if (a<b) x('</p>')</script></head><body><nav><li><a href=a>One</a><li>Two</nav><div class='ad'>Buy now, it is a very long advert text that goes on</div><article><h1>Head &amp; more</h1><p>A  <b>bold</b>\n word<br>next<p>Second &lt;p&gt;<aside>side</aside><p>Third</article><section id=comments><p>A reader comment which is rather long too</section><footer>&copy; me</footer></body></html>"
    assert html_text.main_text(page) == "Head & more\nA bold word next\nSecond <p>\nThird"
    plain = "<div id=menu>a b c</div><div><p>One long line of an article without the tag.</p><p>Two.</p></div><div class=footer>f</div>"
    assert html_text.main_text(plain) == "One long line of an article without the tag.\nTwo."
    for empty in ("", "<p></p>", "<nav>only</nav>", "<!-- c -->", "<script>x", "<"):
        assert html_text.main_text(empty) in ("", "<")
    assert html_text.main_text("<p>unclosed <b>tags <i>here") == "unclosed tags here"
    assert len(html_text.main_text("<p>" + "long text " * 50_000)) == 499_999


def test_stretches_surge_and_dive():
    assert html_text.stretches([0, 5, 0, 3, 0, 0, 0, 7], 3) == [(1, 4), (7, 8)]
    assert html_text.stretches([], 3) == [] and html_text.stretches([0, 0], 3) == []


LINE = "A long sentence of the article that goes on for a while."
PAGES = [
    (f"<script><!-- x </script><article><p>{LINE}</article>", LINE),
    (f"<article><p>{LINE} one</article><div>x</div><article><p>{LINE} two and more</p></article>", f"{LINE} one\n{LINE} two and more"),
    (f"<div><p>{LINE} 1</p><p>{LINE} 2</p><ul><li><a>rel 1</a><li><a>rel 2</a><li><a>rel 3</a></ul><p>{LINE} 3</p></div>", f"{LINE} 1\n{LINE} 2\n{LINE} 3"),
    (f"<nav><ul><li><a>a</a><main><p>{LINE}</p></main>", LINE),
    (f"<nav><a>a</a><article><p>{LINE}</p></article>", LINE),
    (f'<div class="story notice"><p>{LINE}</p></div>', LINE),
    (f'<article class="story notice"><p>{LINE}</p></article>', LINE),
    (f'<article><p>{LINE}</p><div id="ad-free-reading"><p>{LINE} b</p></div></article>', f"{LINE}\n{LINE} b"),
    (f'<article><div class="article-header"><h1>Head</h1></div><p>{LINE}</p></article>', f"Head\n{LINE}"),
    (f"<article><h1>T</h1><p>{LINE}</p></article><h3>Comments (2)</h3><div><p>Nice one, this is a comment that goes on.</p></div>", f"T\n{LINE}"),
    (f"<div><h1>T</h1><p>{LINE}</p><h3>2 Comments</h3><div><p>Nice one, this is a comment that goes on.</p></div></div><footer>x</footer>", f"T\n{LINE}"),
    (f"<article><h1>T</h1><p>{LINE}</p><h3>Comments</h3><div><p>Nice one</p></div><h2>Next</h2><p>{LINE} z</p></article>", f"T\n{LINE}\nNext\n{LINE} z"),
    (f"<div><a>Home</a> | <a>About</a> | <a>C</a></div><div><h1>T</h1><p>{LINE}</p><p>Short.</p></div><div>© 2024 The site</div><div><a>x</a> <a>y</a></div>", f"T\n{LINE}\nShort."),
    (f"<article><h1><a href=x>Title</a></h1><p>{LINE}</p><p>***</p></article>", f"Title\n{LINE}\n***"),
    (f'<article><p>{LINE}</p></article><div class="comment-list"><p>{LINE} c</p></div>', LINE),
    (f"<p>{LINE}</p>" * 10 + "<article><a>Teaser</a> x</article>", "\n".join([LINE] * 10 + ["Teaser x"])),
    (f"<main><article><p>{LINE}</p></article><p>around</p></main>", LINE),
    (f"<article><p>{LINE}</p><p><a>See this</a></p><p>{LINE} 2</p></article>", f"{LINE}\nSee this\n{LINE} 2"),
    (f"<article><p>{LINE}</p><section id=comments><article class=comment><p>{LINE} c</p></article></section></article>", LINE),
    (f"<html><head><title>T<body><p>{LINE}", LINE),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_main_text_of_hard_pages(page, text):
    assert html_text.main_text(page) == text


def test_stretches_like_brute_force():
    r = random.Random(7)
    for _ in range(500):
        w, window = [r.choice([0, 0, 0, 1, 9]) for _ in range(r.randint(0, 25))], r.randint(1, 4)
        weighs = [k for k, x in enumerate(w) if x]
        parts = []
        for k in weighs:
            if parts and not any(sum(w[s : s + window]) == 0 for s in range(parts[-1][-1] + 1, k - window + 1)):
                parts[-1].append(k)
            else:
                parts.append([k])
        found = html_text.stretches(w, window)
        assert [[k for k in range(a, b) if w[k]] for a, b in found] == parts and all(w[a] for a, _ in found)
        assert html_text.peak(w, window) == max((sum(w[s : s + window]) for s in range(len(w))), default=0)


def test_main_text_of_the_supplied_pages(spark):
    """Whole articles by the template of these pages, with the classes and ids and without them."""
    from html import unescape

    pages = common.table(spark, SF, "pages")
    bare = pages.withColumn("html", F.regexp_replace("html", r'\s(?:class|id)="[^"]*"', ""))
    for found in (html_text.extracted(pages, ["html", "page_id"]), html_text.extracted(bare, ["html", "page_id"])):
        for row in found.collect():
            article = re.search("<article>(.*)</article>", row["html"], re.S)[1]
            blocks = [" ".join(unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:p|h1)>|<br>", article)]
            assert row["text"] == "\n".join(filter(None, blocks)) and row["n_chars"] == len(row["text"])


def test_main_text_of_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int, read string"
    rows = [(1, None, None, "t", 1, "r"), (None, "u", "", None, None, None), (2, "u", f"<p>{LINE}", "t", 1, "r"), (2, "u", f"<p>{LINE}", "t", 1, "r"), (3, "u", "<p>" + LONG, "t", 1, "r")]
    pages = spark.createDataFrame(rows, schema)
    found = html_text.extracted(pages, ["page_id", "url"]).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in found) == [(0, "", 0), (1, "", 0), (2, LINE, len(LINE)), (2, LINE, len(LINE)), (3, LONG.strip(), len(LONG) - 1)]
    assert html_text.extracted(pages, pages.columns, text="main", n_chars="size").columns == [*pages.columns, "main", "size"]
    assert html_text.extracted(pages.limit(0), ["page_id"]).count() == 0


# 3 decontamination


def distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_matches_like_full_dynamic_programming():
    r = random.Random(2)
    letter = lambda: r.choice("abcde ")
    items = [(i, "".join(letter() for _ in range(r.randint(15, 70))).strip()) for i in range(12)]
    m = decontam.Matcher(items + [(90, None), (91, "")], 10)
    for _ in range(150):
        text = "".join(letter() for _ in range(30))
        for _, item in r.sample(items, 2):
            edited = list(item)
            for _ in range(r.randint(0, 8)):
                k = r.randrange(len(edited))
                edited[k : k + r.choice([0, 1, 1])] = r.choice([[], [letter()]])
            text += "".join(edited) + "".join(letter() for _ in range(20))
        text = decontam.plain(text)
        want = [{"item_id": i, "distance": d} for i, t in items if (d := distance_in(decontam.plain(t), text)) <= decontam.budget(len(decontam.plain(t)), 10)]
        assert m.hits(text) == want


def test_clean_keeps_the_rest(spark, odd):
    items = spark.createDataFrame([(1, "Text  WITHOUT id"), (2, None), (3, ""), (4, "one the")], "item_id long, text string")
    left = decontam.clean(odd, items, block_chars=5)
    assert left.columns == odd.columns and left.count() == 6
    assert decontam.clean(odd, items.limit(0)).count() == odd.count()
    found = decontam.matches(odd, items, block_chars=5)
    assert sorted((r[0] or 0, r[1]) for r in found.collect()) == [(0, 1), (1, 4), (1, 4)]
    assert decontam.matches(odd, items.limit(0)).count() == 0


# 4 token counts


def test_short_items_are_whole_words():
    m = decontam.Matcher([(1, "art"), (2, "4 × 5"), (3, "")], 12)
    assert m.hits("start the party, apart") == [] and m.hits("14 × 56") == []
    assert m.hits("Party of ART.") == [{"item_id": 1, "distance": 0}] and m.hits("say 4 × 5?") == [{"item_id": 2, "distance": 0}] == m.hits("4 × 5")


def test_items_without_id_count(spark):
    items = spark.createDataFrame([(None, "the one the two"), (4, "é😀 中文 +1"), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "see the one the two"), (2, "é😀 中文 +1"), (3, "clean")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.matches(docs, items).collect()) == [(1, None), (2, 4)]
    assert [r["doc_id"] for r in decontam.clean(docs, items).collect()] == [3]


def test_texts_are_encoded_once(spark, odd):
    """The library's own ranks and pattern, built here, give the same histogram; and no text is encoded for it twice."""
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd.unionByName(common.table(spark, SF, "documents").limit(0), allowMissingColumns=True)
    rows, total = common.table(spark, SF, "documents").select("text").collect() + docs.select("text").collect(), spark.sparkContext.accumulator(0)
    want = Counter(len(plain.encode_ordinary(r["text"] or "")) for r in rows)

    def seen(batches):
        for b in batches:
            total.add(b.num_rows)
            yield b

    every = common.table(spark, SF, "documents").select("text").unionByName(docs.select("text"))
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.encoded_lengths(every.mapInArrow(seen, every.schema), [])))
    assert {r["n_tokens"]: r["n_docs"] for r in sums.collect()} == want and total.value == len(rows)


def test_suffix_sums(spark):
    lengths = [0, 0, 3, 5, 5, 5000, 9000, 9000, 123456]
    hist = token_counts.histogram(spark.createDataFrame([(x,) for x in lengths], "n_tokens long"))
    sums = token_counts.suffix_sums(hist)
    for r in sums.collect():
        n = r["n_tokens"]
        assert r["docs_at_least"] == sum(x >= n for x in lengths) and r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths) and r["docs_share"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    for r in token_counts.at_limits(sums, [0, 4, 5, 8192, 10**6]).collect():
        assert r["truncated_tokens"] == sum(min(x, r["context_limit"]) for x in lengths)
    assert by_id(token_counts.quantiles(sums, [0.5, 1.0]), "share")[0.5]["n_tokens"] == 5
    assert token_counts.suffix_sums(hist.limit(0)).count() == 0


def test_token_lengths_like_the_library(spark, odd):
    e = token_counts.encoding(open(common.tokenizer_file(token_counts.VOCABULARY), "rb").read(), token_counts.PATTERN)
    found = token_counts.encoded_lengths(odd, ["doc_id", "text"])
    assert all(r["n_tokens"] == len(e.encode_ordinary(r["text"] or "")) for r in found.collect())


# 5 toxicity


def test_block_max_index_is_exact():
    r = np.random.default_rng(1)
    rows = []
    for _ in range(500):
        at = np.sort(r.choice(60, r.integers(1, 8), replace=False))
        w = r.random(len(at))
        rows.append((at, w / np.linalg.norm(w)))
    index = toxicity.BlockMaxIndex(rows, 60)
    dense = np.zeros((500, 60))
    for i, (at, w) in enumerate(rows):
        dense[i, at] = w
    for i, (at, w) in enumerate(rows[:100]):
        ids, scores = index.top(at, w, 15, but=i)
        every = dense @ dense[i]
        every[i] = 0
        want = np.lexsort((np.arange(500), -np.round(every, 9)))[:15]
        want = want[every[want] > 0]
        assert ids.tolist() == want.tolist() and np.allclose(scores, every[want])


def test_isotonic_rises():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0, 1, 0, 1, 1]))
    assert x.tolist() == [0.1, 0.1, 0.2, 0.3, 0.4, 0.5] and y.tolist() == [0, 0, 0.5, 0.5, 1, 1]
    assert toxicity.isotonic(np.zeros(4), np.array([0, 1, 0, 1]), 0.5, 1)[1].tolist() == [0.5, 0.5]


def plain_terms(text):
    own = Counter()
    for w in re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode()):
        own.update([(0, w), *((k, w[:k]) for k in (4, 6) if len(w) > k)])
    return own


def plain_vote(sample, text):
    """The vote by dictionaries: all terms that two rows have, cosines of every example."""
    rows = [(plain_terms(t), y) for t, y in sample]
    df, bad = (Counter(w for c, y in rows if y or not only for w in c) for only in (False, True))
    n, n_bad = len(rows), sum(y for _, y in rows)
    idf = {w: max(np.log((n + 1) / (d + 0.5)), 0) for w, d in df.items() if d > 1}
    gain = {w: max(np.log((bad[w] + 0.5) / (n_bad + 1) / ((df[w] - bad[w] + 0.5) / (n - n_bad + 1)) / 2), 0) if bad[w] > 1 else 0 for w in idf}

    def unit(c):
        v = {w: (1 + np.log(k)) * idf[w] for w, k in c.items() if w in idf}
        length = sum(x * x for x in v.values()) ** 0.5 or 1
        return {w: x / length for w, x in v.items()}

    own, cosines = unit(plain_terms(text)), ([], [])
    for c, y in rows:
        other = unit(c)
        cosines[y].append(sum(x * other.get(w, 0) * gain[w] for w, x in own.items()))
    return (sum(sorted(cosines[1])[-15:]) - sum(sorted(cosines[0])[-15:])) / 15


def as_sample(rows):
    own = [(i, y, *toxicity.term_counts(t)) for i, t, y in rows]
    return toxicity.Sample.of((i, y, t.tobytes(), n.astype(np.uint32).tobytes()) for i, y, t, n in own)


def test_votes_like_plain_cosines(monkeypatch):
    r = random.Random(4)
    word = lambda bad: r.choice(["drubzik", "drubzikovic", "Vexé", "the"] if r.random() < bad else ["the", "and", "é", "x1"]) if r.random() < 0.6 else "".join(r.choice("abcde") for _ in range(r.randint(1, 8)))
    texts = [(" ".join(word(0.4 * (i % 3 == 0)) for _ in range(r.randint(0, 60))) + r.choice(["", "!", "\n"]), int(i % 3 == 0)) for i in range(240)]
    model = toxicity.fitted(as_sample((i, t, y) for i, (t, y) in enumerate(texts[:200])))
    some = [toxicity.term_counts(t) for t, _ in texts[200:]]
    for (t, _), found in zip(texts[200:], some):
        assert model.near.vote(*toxicity.placed(model.vocabulary, *found))[0] == pytest.approx(plain_vote(texts[:200], t), abs=1e-12)
    assert sum(abs(plain_vote(texts[:200], t)) > 1e-3 for t, _ in texts[200:]) > 20
    from graphloom.llm import words

    monkeypatch.setattr(toxicity, "PIECE", 16)
    assert all((toxicity.term_counts(t)[0].tolist(), toxicity.term_counts(t)[1].tolist()) == (a.tolist(), n.tolist()) for (t, _), (a, n) in zip(texts[200:], some))
    assert words.PIECE > 16


@pytest.mark.parametrize("sf, recall", [("sf0.01", 0.8), ("sf0.1", 0.9)])
def test_toxicity_of_the_supplied_tables(spark, sf, recall):
    """Some 5 % of the rows labelled toxic hold nothing that others of them hold, so recall is bounded."""
    folder = f"/root/testdata/{sf}"
    said = common.table(spark, folder, "labels")
    found = toxicity.digest(common.table(spark, folder, "documents"), said).where("held_out").join(said, "doc_id")
    bad, caught, good, flagged = found.select(F.sum("toxic"), F.sum(F.col("toxic") * F.col("predicted")), F.sum(1 - F.col("toxic")), F.sum((1 - F.col("toxic")) * F.col("predicted"))).first()
    assert caught >= recall * bad and flagged <= 0.02 * good, (bad, caught, good, flagged)


def test_the_labelled_sample(spark):
    """One row for each id and text, the highest label, no long text, and no more text than allowed."""
    docs = spark.createDataFrame([(i, f"text {i % 50} " + "x" * (i % 7)) for i in range(400)] + [(1000, "y" * 500), (7, "again")], "doc_id long, text string")
    said = spark.createDataFrame([(i, i % 2) for i in [*range(400), 1000]] + [(2, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.labelled_sample(docs, said, "doc_id", "text", "toxic", 100, 64 * 100).collect()
    assert len({(r["text"], r["toxic"]) for r in rows}) == len(rows) == len({r["id"] for r in rows}) > 50 and max(len(r["text"]) for r in rows) <= 100
    few = toxicity.labelled_sample(docs, said, "doc_id", "text", "toxic", 100, 64 * 20).collect()
    assert 0 < sum(len(r["text"]) for r in few) <= 64 * 20 and {r["id"] for r in few} <= {r["id"] for r in toxicity.labelled_sample(docs, said, "doc_id", "text", "toxic", 100, 64 * 100).collect()} | {r["id"] for r in few}


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(5)
    say = lambda n, bad: " ".join("".join(r.choice("aeioult") for _ in range(r.randint(2, 7))) if r.random() > bad else r.choice(["vexqor", "Vexqam", "drubzik"]) for _ in range(n))
    rows = [(i, say(60, 0.06 if i % 4 == 0 else 0), int(i % 4 == 0)) for i in range(900)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    found = by_id(toxicity.digest(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")))
    held = [(found[i]["predicted"], y) for i, _, y in rows if found[i]["held_out"]]
    assert 250 < len(held) < 350 and sum(p == y for p, y in held) / len(held) > 0.97


def test_toxicity_on_odd_rows(spark, odd, labels):
    out = toxicity.clean(odd, labels)
    assert out.columns == odd.columns and out.count() <= odd.count()
    assert toxicity.digest(odd, labels.limit(0)).where("score = 0.5").count() == odd.count()
    assert toxicity.digest(odd.limit(0), labels).count() == 0


# 6 language-model scores


def test_losses_are_cross_entropies():
    a, b = lm_score.cells("x y x y"), lm_score.cells("y x")
    counts = [np.bincount(a[0], minlength=lm_score.VOCABULARY), np.bincount(a[1], minlength=lm_score.PAIRS)]
    got = lm_score.losses(lm_score.log_model(*counts), *b)
    alone = 0.9 * 2 / 4 + 0.1 / lm_score.VOCABULARY
    assert got[0] == pytest.approx(-np.log(alone), rel=1e-5) and got[1] == pytest.approx(-np.log(0.7 * 0.5 + 0.3 * alone), rel=1e-5)


def test_scores_prefer_the_target(spark, odd, labels):
    docs = spark.createDataFrame([(i, ("good fine words here " if i % 2 else "bad junk stuff there ") * 5) for i in range(40)], "doc_id long, text string")
    said = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    found = by_id(lm_score.scored(docs, said, ["doc_id"]))
    assert min(found[i]["score"] for i in range(1, 40, 2)) > 0 > max(found[i]["score"] for i in range(0, 40, 2))
    assert lm_score.scored(odd, labels, ["doc_id"]).count() == odd.count() and by_id(lm_score.scored(odd, labels, ["doc_id"]))[3]["n_words"] == 0
    assert lm_score.scored(odd.limit(0), labels.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_scores_are_of_exact_counts(spark, monkeypatch, few):
    """More pairs than a table of fixed size tells apart, in several chunks and buckets, like plain counting; labels broadcast and not."""
    monkeypatch.setattr(lm_score, "FEW", few)
    monkeypatch.setattr(lm_score, "CHUNK_CHARS", 3000)
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 20_000)
    r = random.Random(6)
    texts = [" ".join(f"w{r.randrange(40_000)}" if r.random() < 0.7 else r.choice("abc") for _ in range(r.randint(0, 400))) for _ in range(300)]
    good = {i for i in range(300) if i % 3 == 0}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    said = spark.createDataFrame([(i, int(i in good)) for i in range(300) if i % 2 == 0 or i in good], "doc_id long, quality int")
    found = by_id(lm_score.scored(docs, said, ["doc_id"]))
    assert len(found) == 300
    size = len({w for t in texts for w in t.split()})
    for name, own in (("target_loss", good), ("background_loss", range(300))):
        words = Counter(w for i in own for w in texts[i].split())
        pairs = Counter(p for i in own for p in zip(texts[i].split(), texts[i].split()[1:]))
        n = sum(words.values())
        for i, t in enumerate(texts):
            w = t.split()
            each = []
            for k, x in enumerate(w):
                p, before = 0.9 * words[x] / n + 0.1 / size, words[w[k - 1]] if k else 0
                each.append(-np.log(0.7 * pairs[w[k - 1], x] / before + 0.3 * p if before else p))
            assert found[i]["n_words"] == len(w) and found[i][name] == pytest.approx(np.mean(each) if each else 0, rel=1e-9, abs=1e-12)


# 7 quality


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    twice = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(twice)]


def test_rule_counts_like_brute_force():
    r = random.Random(8)
    for _ in range(300):
        text = "".join(r.choice(["a", "bé", "😀", "#", "|x", " ", " ", "w1 w2 w3 w4 w5 w6 w7 w8 w9 "]) + r.choice([" ", "\n", "\t", "\x1c", "\r", ""]) for _ in range(r.randint(0, 60)))
        assert quality_forest.statistics(text)[0] == brute_counts(text)


def test_forest_finds_outliers_and_keeps_good_rows():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 1, (950, 4)), r.normal(9, 1, (50, 4))])
    bad = np.arange(1000) >= 950
    s = quality_forest.Forest(x).score(x)
    limit = quality_forest.threshold(s, bad)
    assert (s[bad] >= limit).mean() > 0.9 and (s[~bad] >= limit).mean() <= quality_forest.GOOD_LOSS
    assert quality_forest.threshold(s, np.zeros(1000, bool)) == float("inf")


def plain_depth(forest, row, tree):
    at = int(forest.roots[tree])
    while forest.left[at] != at:
        at = int(forest.left[at] if row[forest.feature[at]] <= forest.split[at] else forest.right[at])
    return forest.depth[at]


def test_path_lengths_like_plain_walks():
    x = np.random.default_rng(3).normal(0, 1, (300, 5))
    forest = quality_forest.Forest(x, trees=9, subsample=64)
    mean = [np.mean([plain_depth(forest, row, t) for t in range(9)]) for row in x]
    # of n rows a search tree's unsuccessful search takes 2 H(n-1) - 2 (n-1) / n steps
    norm = 2 * (np.log(63) + 0.5772156649) - 2 * 63 / 64
    assert np.allclose(forest.score(x), 2 ** (-np.array(mean) / norm))


def test_the_forest_gains_on_rows_that_it_was_not_fitted_to(spark):
    """Fitted on half of the labels of sf0.1, judged on the other half, against the base rules alone."""
    said = common.table(spark, "/root/testdata/sf0.1", "labels").where("quality is not null")
    docs, half = common.table(spark, "/root/testdata/sf0.1", "documents"), F.crc32(F.col("doc_id").cast("string")) % 2
    found = quality_forest.judged(docs, said.where(half == 0), ["doc_id"]).join(said.where(half == 1), "doc_id")
    share = {(r["quality"], n): r[n] for r in found.groupBy("quality").agg(F.avg(F.col("base_failed").cast("int")).alias("base"), F.avg((~F.col("kept")).cast("int")).alias("both")).collect() for n in ("base", "both")}
    assert share[0, "both"] > 0.7 > 0.5 > share[0, "base"] and share[1, "both"] < share[1, "base"] + 0.015, share


def test_forest_and_threshold_come_from_all_labelled_rows(spark):
    """12 000 labelled rows: what a plain threshold over all of them says, and no label is without effect."""
    r = random.Random(4)
    texts = [" ".join(r.choice(["the", "of", "word", "x1", "#", "Ab,"]) + str(r.randrange(50)) for _ in range(r.randint(15, 40))) for _ in range(12_000)]
    bad = [r.random() < 0.02 for _ in texts]
    texts = [t + " $ | # < >" * r.randint(0, 6) if b else t for t, b in zip(texts, bad)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(not b)) for i, b in enumerate(bad)], "doc_id long, quality int")
    found = by_id(quality_forest.judged(docs, labels, ["doc_id"]))
    open_to = [i for i in found if not found[i]["base_failed"]]
    limit = quality_forest.threshold(np.array([found[i]["anomaly"] for i in open_to]), np.array([bad[i] for i in open_to]))
    assert limit < 1 and all(found[i]["kept"] == (found[i]["anomaly"] < limit) for i in open_to)
    drawn = quality_forest.draws(12_000)
    assert len(np.unique(drawn)) > 10_000 and all(len(set(x)) == quality_forest.SUBSAMPLE for x in drawn.tolist())


def test_quality_on_odd_rows(spark, odd, labels):
    found = quality_forest.judged(odd, labels, ["doc_id"])
    assert found.count() == odd.count() and by_id(found)[5]["base_failed"] and by_id(found)[3]["n_words"] == 0
    assert quality_forest.judged(odd.limit(0), labels.limit(0), ["doc_id"]).count() == 0


def test_word_hashes_do_not_depend_on_place():
    data = ("x" * 700_000 + " the " + "y " * 400_000 + "the").encode()
    h = words.word_hashes(data)
    assert len(h) == 400_003 and h[1] == h[-1] == words.word_hashes(b"the")[0] != h[2] and len(words.word_hashes(b" \n")) == 0


# 8 pieces


def test_pieces_like_the_library(spark, odd):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_file(pieces.MODEL))
    encoder, decoder = pieces.ready(pieces.read_model())
    r = random.Random(1)
    texts = ["".join(r.choice("a b\n▁ththeéß中😀\x00  .,12ABx<0x41>") for _ in range(r.randint(0, 40))) for _ in range(2000)]
    texts += [" " * n for n in range(40)] + ["a" * n + "the" * n for n in range(40)] + ["  a\n\n b ", LONG[:5000], "ab\r\ncd"]
    for t in texts:
        ids = np.frombuffer(encoder.encode(t), "<u4").tolist()
        assert ids == lib.encode(t) and decoder.decode([1, *ids, 2]) == lib.decode(ids), t
    for _ in range(500):
        ids = [r.randrange(400) for _ in range(r.randint(0, 12))]
        assert decoder.decode(ids) == lib.decode(ids)
    for row in pieces.encoded(odd, ["text"], ids=True, decoded=True).collect():
        want = lib.encode(row["text"] or "", add_bos=True, add_eos=True)
        assert row["ids"] == want and row["decoded"] == lib.decode(want) and row["n_tokens"] == len(want)
        assert row["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert pieces.encoded(odd.limit(0), ["doc_id"]).count() == 0


def test_backtracking_steps_back():
    encoder, _ = pieces.ready(pieces.read_model())
    for w in ("▁thtionblerewh", "▁unbelievableness", "abababab"):
        assert encoder.backtracked(w) == encoder.known_run(w) == encoder.merged(w)


# 9 SimHash


def brute_fingerprint(text):
    import xxhash

    w = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark, odd):
    for t in ("", "One", "one TWO", "Ä b c D e", "a b c " * 30, "x y z q r s"):
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    hashed = spark.createDataFrame([("a b c",)], "s string").select(F.xxhash64("s")).first()[0]
    assert simhash.fingerprint("A b C") == hashed % (1 << 64)


@pytest.mark.parametrize("blocks", [1, 2, 3])
def test_codes_are_perfect_and_cover_pairs(blocks):
    a = simhash.Anchors(blocks=blocks)
    r = np.random.default_rng(3)
    fp = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = fp.copy()
    for i in range(300):
        for b in r.choice(64, i % 3, replace=False):
            near[i] ^= np.uint64(1 << int(b))
    homes, sent, number = a.of(near)
    own, _, _ = a.of(fp)
    for i in range(300):
        assert own[i] in sent[number == i] and homes[i] in sent[number == i]
    for code, (_, bits, radius) in zip(a.codes, simhash.BLOCKS):
        assert max(int(x).bit_count() for x in code.leader) == radius
        # perfect: the words within the radius of the codewords are all words, each once
        assert sum(len(list(combinations(range(bits), k))) for k in range(radius + 1)) << (bits - code.degree) == 1 << bits


def test_links_do_not_depend_on_the_blocks(spark):
    r = random.Random(10)
    base = [r.getrandbits(64) for _ in range(300)]
    every = list(dict.fromkeys(base + [x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for x in base for _ in range(2)] + [1 << k for k in range(64)] + [0]))
    signed = [x - (1 << 64) if x >> 63 else x for x in every]
    want = {(min(a, b), max(a, b)) for (a, x), (b, y) in combinations(list(zip(signed, every)), 2) if (x ^ y).bit_count() <= 2}
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    for blocks in (None, 2, 3):
        rows = [(x["src"], x["dst"]) for x in simhash.links(fps, blocks=blocks).distinct().collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 2000


def test_what_goes_to_the_anchors_is_not_broadcast(spark):
    """Each fingerprint becomes some sixty rows, which Spark's sizes don't show."""
    found = simhash.links(spark.range(2000).select(F.xxhash64("id").alias("fp")))
    assert found.isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan, plan


def test_one_root_may_have_most_rows(spark):
    """A chain of fingerprints through 65 others, and one fingerprint in half of the rows."""
    chain = [(1 << k) - 1 for k in range(64)]
    rows = [(i, chain[i % 64]) for i in range(3000)] + [(10_000 + i, 1 << 62 | 1 << 50 | 1 << 40) for i in range(3000)]
    prints = spark.createDataFrame(rows, "doc_id long, fp long")
    found = prints.join(simhash.components(prints), "fp").groupBy("component_id").count().collect()
    assert sorted(map(tuple, found)) == [(0, 3000), (10_000, 3000)]


def test_components_of_fingerprints(spark):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = base + [b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(4)] + [0, 0, 3, 12, 48]
    rows = list(enumerate(fps))
    parent = list(range(len(fps)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    prints = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in rows], "doc_id long, fp long")
    found = by_id(simhash.components(prints), "fp")
    assert all(found[x - (1 << 64) if x >> 63 else x]["component_id"] == top(i) for i, x in rows)


def test_near_duplicates_of_odd_rows(spark, odd):
    found = simhash.classes(odd)
    assert found.count() == odd.count() and {r["component_id"] for r in found.where("fingerprint = '0000000000000000'").collect()} == {2}
    left = simhash.deduplicated(odd)
    assert left.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 1, 2, 5, 7]
    assert simhash.deduplicated(odd.limit(0)).count() == 0


# 10 repeated byte strings


def brute_kept(texts):
    seen = Counter(t[p : p + 200] for t in texts for p in range(len(t) - 199))
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p] += 1
                gone[p + 200] -= 1
        keep = np.cumsum(gone)[: len(t)] == 0
        yield len(t), int((~keep).sum()), int((np.diff(np.concatenate([[1], keep.astype(int)])) == -1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[keep].tobytes()).hexdigest()


def test_removal_like_brute_force(spark):
    r = random.Random(5)
    some = lambda n: " ".join(r.choice(["the", "of", "é", "qua", "on"]) + str(r.randint(0, 99)) for _ in range(n))
    passages, texts = [some(r.randint(20, 120)) for _ in range(15)], []
    for _ in range(120):
        t = ""
        for _ in range(r.randint(1, 5)):
            p, k = r.choice(passages), r.random()
            a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p))))
            t += some(r.randint(1, 60)) if k < 0.4 else p[a:b] if k < 0.8 else p
        texts.append(t)
    texts += ["a" * 1000, "a" * 250, "ab" * 300, "", None, "x" * 199, "y" * 200, "y" * 200, texts[3], texts[3], texts[4]]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, k1 string")
    found = by_id(suffix_dedup.deduplicated(docs, ["doc_id", "k1"]))
    for i, want in enumerate(brute_kept([(t or "").encode() for t in texts])):
        assert (found[i]["n_bytes"], found[i]["n_removed"], found[i]["n_spans"], found[i]["kept_sha256"]) == want, i


def test_removal_on_odd_rows(spark, odd):
    found = suffix_dedup.deduplicated(odd, ["doc_id"], kept=True)
    assert found.count() == odd.count() and by_id(found)[5]["n_removed"] == len(LONG) and by_id(found)[7]["n_removed"] == 0
    assert suffix_dedup.deduplicated(odd.limit(0), ["doc_id"]).count() == 0


def test_loser_tree_merges_and_never_compares_known_prefixes():
    r = random.Random(6)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 60))) for _ in range(7)]
    tree = suffix_dedup.LoserTree([suffix_dedup.front_coded(x) for x in runs])
    out = list(tree)
    assert [s for _, _, s, _ in out] == sorted(x for run in runs for x in run)
    before = b""
    for _, _, s, shared in out:
        assert shared == suffix_dedup.common(before, s, 0)
        before = s
    assert all(runs[r][k] == s for r, k, s, _ in out)


# all of them


def test_queries_keep_every_row(spark):
    from graphloom.llm import queries

    docs = common.table(spark, SF, "documents").count()
    for name in ("op1_pii", "op5_toxicity", "op9_simhash"):
        assert queries.queries()[name](spark, SF).count() == docs
