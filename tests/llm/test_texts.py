"""Operators on one text at a time, against plain versions."""

import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from lakeweave.llm import decontam, html_text, quality, repair, simhash
from lakeweave.llm.entries import BYTE_BPE, WORD_BPE, tokenizer_file
from lakeweave.llm.token_counts import PieceCounts, slices
from lakeweave.llm.token_output import Encoder

ODD = [
    "", "  a\n\nb  ", "<|endoftext|> x<|startoftext|>", "İstanbul Σας ὈΔΥΣΣΕΎΣ", "a\tb\r\nc d", "é ́x", "日本語 text ½ ² it's we'LL", "\x1c\x00 z\x00y", "x" * 3000,
    "a<|b |> 'S'T", " q w", "a   b", "a \n b", "a \n  b", "\n \nb", "   ", "\n", " ", "a ", " a", "tab\t \tb", "end<|endoftext|>", "a b", "ﬁ ǆ K", "1234 5.6%",
]


@pytest.fixture(scope="module")
def texts(small):
    return pq.read_table(f"{small}/documents.parquet")["text"].to_pylist()


def random_texts(n, seed=5):
    r = random.Random(seed)
    parts = ["a", "The", "é", " ", "  ", "\n", "\t", ".", "'s", "9", "½", "ß", " ", " ", "<|endoftext|>", "日", "!!", "word", "-", "İ", "Σ"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_token_counts_are_the_librarys(texts):
    from tokenizers import Tokenizer

    path = tokenizer_file(BYTE_BPE)
    own = PieceCounts(path, table_entries=500)
    some = [*ODD, *random_texts(3000), *texts[:60]]
    got = [n for a, b in slices(some, 5000) for n in own.counts(some[a:b])]
    assert got == [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]


def test_texts_with_white_space_runs_are_cut_too():
    own = PieceCounts(tokenizer_file(BYTE_BPE))
    code = "def f(x):\n    if x:\n        return  x + 1\n\n\n    return <|endoftext|> None  # \t end " * 50
    assert len(own.split(code)) > 200
    assert own.counts([code, f"  {code}", code.replace(" ", "  ")]) == own.whole([code, f"  {code}", code.replace(" ", "  ")])


def test_token_ids_are_the_librarys(texts):
    from tokenizers import Tokenizer

    path = tokenizer_file(WORD_BPE)
    some = [None, *ODD, *random_texts(3000), *texts[:60]]
    ids, ends = Encoder(path).encode(some, 2)
    starts = np.append(0, ends)
    want = Tokenizer.from_file(path).encode_batch([x or "" for x in some], add_special_tokens=False)
    for i, e in enumerate(want):
        assert ids[starts[i] : starts[i + 1]].tolist() == [*e.ids, 2], repr(some[i])
    assert Encoder(path).encode([], 2)[0].tolist() == []


def test_chunks_are_told_apart_by_their_bytes_and_memory_changes_nothing(texts):
    """Words of a Thue-Morse word and its complement share every polynomial hash modulo 2**64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    r = random.Random(1)
    vocabulary = [t.removesuffix("</w>") for t in Encoder(tokenizer_file(WORD_BPE)).tokenizer.get_vocab()]
    made = ["".join(r.choice(vocabulary) for _ in range(r.randint(1, 4))) for _ in range(4000)]
    made += ["".join(r.choice("abcABCäßéİſ'!-.,9\u0301\u2003\x0c ") for _ in range(r.randint(1, 40))) for _ in range(4000)]
    some = [word, other, f"{other} {word}", "<|ENDOFTEXT|> <|endoftext|>.", "A.B, 'S. It's, x.", "ab.,", "a., b.", *made, *texts[:40]]
    own = Encoder(tokenizer_file(WORD_BPE), memory=300)
    want = own.tokenizer.encode_batch(some, add_special_tokens=False)
    for at in range(0, len(some), 500):
        ids, ends = own.encode(some[at : at + 500], 2)
        for a, b, e in zip([0, *ends.tolist()], ends.tolist(), want[at:], strict=False):
            assert ids[a:b].tolist() == [*e.ids, 2]


def test_plain_chunks_need_the_model_alone():
    from tokenizers import Tokenizer

    path, r = tokenizer_file(WORD_BPE), random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz" * 3 + "".join(map(chr, range(0xDF, 0x100))).replace("÷", "")
    some = [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 14))) for _ in range(40)) for _ in range(100)]
    marked = [re.sub(" ", lambda _: r.choice(".,;!%# ") + " ", x) for x in some] + ["È. é's É<|endoftext|> ä×. ö÷, ×! ÷! ß-ß é=\u0338 ñ.\u0301 à"]

    class Silent:
        def encode(self, *_, **__):
            raise AssertionError("a plain chunk took the long way")

    def check(own, texts):
        ids, ends = own.encode(texts, 2)
        for a, b, x in zip([0, *ends.tolist()], ends.tolist(), texts, strict=False):
            assert ids[a:b].tolist() == [*want[x], 2]

    want = {x: e.ids for x, e in zip([*some, *marked], Tokenizer.from_file(path).encode_batch([*some, *marked], add_special_tokens=False), strict=True)}
    short, blind, whole = Encoder(path), Encoder(path), Encoder(path)
    short.tokenizer = Silent()
    check(short, some)
    blind.last[:] = False  # a file that doesn't mark the ends of words
    whole.quick = None
    for own in (Encoder(path), blind, whole):
        check(own, [*some, *marked])


@pytest.mark.parametrize("seed", range(6))
def test_repair_round_trip(seed):
    r = np.random.default_rng(seed)
    terminals, end = (70_000, 2) if seed % 2 else (50, 2)
    docs = [np.append(r.integers(0, min(terminals, 12), r.integers(0, 400)), end) for _ in range(r.integers(1, 60))]
    ids = np.concatenate(docs).astype(np.uint32)
    packed = repair.compress(ids, np.cumsum([len(d) for d in docs]), end, terminals, min_count=3)
    block = repair.Block(packed)
    assert block.sizes().tolist() == [len(d) for d in docs]
    assert np.array_equal(block.decode(0, len(docs)), ids)
    for i in (0, len(docs) // 2, len(docs) - 1):  # random access
        assert block.decode(i, i + 1).tolist() == docs[i].tolist()
    assert len(docs) < 20 or len(packed) < ids.nbytes


@pytest.mark.parametrize("seed", range(4))
def test_repair_leaves_no_frequent_pair(seed):
    r = np.random.default_rng(seed)
    terminals = 65_530 if seed % 2 else 60  # few rules are left in two bytes, or many
    docs = [np.append(r.choice([2, 3, 4, 5, *range(20, 50)], r.integers(0, 300)), 2) for _ in range(40)] + [np.array([7] * 90 + [2])]
    ends = np.cumsum([len(d) for d in docs])
    packed = repair.compress(np.concatenate(docs).astype(np.uint32), ends, 2, terminals, min_count=4)
    block = repair.Block(packed)
    assert np.array_equal(block.decode(0, len(docs)), np.concatenate(docs)) and block.sizes().tolist() == [len(d) for d in docs]
    assert int(np.frombuffer(packed, "<u4", 1, 4)[0]) == (4 if seed % 2 else 2)
    left = {}
    for a, b in zip(block.firsts, block.firsts[1:], strict=False):
        before = None
        for pair in zip(block.symbols[a : b - 1].tolist(), block.symbols[a + 1 : b].tolist(), strict=True):
            before = None if pair == before and pair[0] == pair[1] else pair  # from the left of a run
            left[before] = left.get(before, 0) + 1
    left.pop(None, None)
    assert max(left.values()) < 4


def test_simhash_of_plain_definition(texts):
    import xxhash

    def plain(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        if not words:
            return 0
        n = max(1, len(words) - 3)
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), seed=42) for i in range(n)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)

    for text in [None, *ODD, *random_texts(300), *texts[:40]]:
        assert simhash.fingerprint(text) == plain(text)


def test_lists_give_all_links():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, base ^ np.uint64(5), base[:9] ^ np.uint64(3 << 40), base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    which = np.zeros(len(fp), int)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    for short in (2, 8, 10_000):
        u, v = simhash.links_of_lists(fp, which, 4, short)
        assert components(fp, zip(u.tolist(), v.tolist(), strict=True)) == components(fp, ((fp[i], fp[j]) for i, j in zip(*np.nonzero(near), strict=True)))


def components(nodes, edges):
    up = {int(n): int(n) for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(int(a)), root(int(b))
        up[max(x, y)] = min(x, y)
    return {n: root(n) for n in up}


def tiled(item, doc, width=5):
    return decontam.tiles([(p, q) for p in range(len(item) - width + 1) for q in range(len(doc) - width + 1) if item[p : p + width] == doc[q : q + width]], width)


def test_tiles_take_the_longest_first_and_catch_reordered_parts():
    item = "one two three four five six seven eight nine ten eleven twelve".split()
    assert tiled(item, ["x", *item[6:], "y", "z", *item[:6]]) == [(0, 9, 6), (6, 1, 6)]
    assert tiled(item, item[:8]) == [(0, 0, 8)] and tiled(item, []) == []
    # a document's words count once: two copies of half an item are no whole one
    assert sum(n for _, _, n in tiled(list("abcdefabcdef"), list("abcdef"))) == 6


def plain_tiling(item, doc, width):
    """Textbook greedy string tiling."""
    in_item, in_doc, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for q in range(len(doc)):
                n = 0
                while p + n < len(item) and q + n < len(doc) and item[p + n] == doc[q + n] and p + n not in in_item and q + n not in in_doc:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < width:
            return covered
        in_item.update(range(p, p + n))
        in_doc.update(range(q, q + n))
        covered += n


def test_tiling_equals_the_textbook():
    r = random.Random(2)
    for _ in range(150):
        item = [r.choice("abc") for _ in range(r.randint(5, 16))]
        doc = [r.choice("abc") for _ in range(r.randint(0, 25))]
        assert sum(n for _, _, n in tiled(item, doc)) == plain_tiling(item, doc, 5), (item, doc)


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=x>A</a></li></ul></nav><div class="cookie-notice">We use cookies</div><aside>side</aside>
    <article><h1>Head &amp; tail</h1><p>One   two<br>three&nbsp;four <b>bo</b>ld<p>Short.<form><input value=q>Send</form><div class="ad">Buy</div><!-- no --></article>
    <div id="comments"><article><p>First!</p></article></div><footer>&copy; us</footer></body></html>"""
    assert html_text.main_text(page) == "Head & tail One two three four bold Short."
    assert html_text.main_text(page[: page.index("Short")]) == "Head & tail One two three four bold"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>a</nav>") == ""
    assert html_text.main_text("just text") == "just text"
    soup = '<div id=menu><a>a</a> <a>b</a></div><div class=body><p>A long paragraph of many words that stands in a plain container.</p><p>End.</p></div><div class=links><a>x</a><a>y</a><a>z</a></div>'
    assert html_text.main_text(soup) == "A long paragraph of many words that stands in a plain container. End."


def test_ratios_choose_within_an_article():
    text, links = "A long paragraph of many words that stands in the article itself, and goes on.", "<li><a href=x>More</a></li><li><a href=y>News</a></li><li><a href=z>Tags</a></li>"
    page = f"<body><article><header><h1>Head</h1></header><p>{text}</p><div><p>{text}</p><p>Short.</p></div><div><ul>{links}</ul></div><section><h2>Two</h2><p>{text}</p></section><ul>{links}</ul></article></body>"
    assert html_text.main_text(page) == f"Head {text} {text} Short. Two {text}"
    # an article of links alone doesn't hide the page's text
    page = f"<body><article><ul>{links}{links}</ul></article><div><p>{text}</p><p>{text}</p><p>{text}</p></div></body>"
    assert html_text.main_text(page) == f"{text} {text} {text}"


def test_smoothing_keeps_short_paragraphs_between_long_ones(monkeypatch):
    long, short = "A long paragraph of many words that stands in a box of its own, without any name, and goes on for a while.", "So it was."
    page = "<body>" + "".join(f"<div><p>{x}</p></div>" for x in (long, long, short, long, long)) + "<div><a href=a>One</a> <a href=b>Two</a></div></body>"
    want = " ".join([long, long, short, long, long])
    assert html_text.main_text(page) == want
    monkeypatch.setattr(html_text, "smooth", lambda x, sigma=0: x)
    assert html_text.main_text(page) != want


def neutral(page):
    """A page whose elements and classes tell nothing."""
    return re.sub(r' (class|id|role)="[^"]*"', "", re.sub(r"<(/?)(article|nav|footer|header|aside|main|section)\b[^>]*>", r"<\1div>", page))


def test_neutral_markup(small):
    """Ratios, smoothing and clusters alone: precision and recall of words, by page."""
    import html
    from collections import Counter

    found = []
    for row in pq.read_table(small.replace("sf0.001", "sf0.01") + "/pages.parquet").to_pylist():
        want = Counter(html.unescape(re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*?)</article>", row["html"], re.S)[1])).split())
        got = Counter(html_text.main_text(neutral(row["html"])).split())
        both = sum((want & got).values())
        found.append((both / max(1, sum(got.values())), both / max(1, sum(want.values()))))
    assert min(np.mean(found, axis=0)) >= 0.98


def test_very_long_and_odd_pages():
    line = "words of a line that goes on and on, as lines of very long pages do, until it ends. " * 10
    page = "<body><nav><a href=a>Menu</a></nav>" + f"<p>{line}" * 3000 + "<footer>end</footer></body>"
    assert html_text.main_text(page) == " ".join([line.strip()] * 3000)
    assert html_text.main_text("<div>" * 4000 + "deep" + "</div>" * 4000) == "deep"
    assert html_text.main_text("\x00<p>&#0;&bad; <![CDATA[x]]> <p a=\"<b>\">tail of the page") and html_text.main_text("<!-- open") == ""


def test_pages_of_the_tables(small):
    import html

    for row in pq.read_table(f"{small}/pages.parquet").to_pylist():
        inner = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        assert html_text.main_text(row["html"]) == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def test_quality_model_learns_mains_and_pairs():
    r = np.random.default_rng(0)
    x = r.random((3000, 4))
    y = (((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)) | (x[:, 2] > 0.9)).astype(float)
    model = quality.fit(x, y, np.arange(3000) % 5 == 0)
    fresh = r.random((2000, 4))
    want = ((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5)) | (fresh[:, 2] > 0.9)
    assert ((model.score(fresh) >= 0.5) == want).mean() > 0.93
    assert (1, 0) in {(i, j) for i, j, _ in model.pairs}
    assert np.isfinite(quality.fit(x[:0], y[:0], np.zeros(0, bool)).score(x[:3])).all()
    assert np.isfinite(quality.fit(x[:1], y[:1], np.zeros(1, bool)).score(x[:3])).all()


def test_quality_on_held_out_documents(small):
    base = small.replace("0.001", "0.1")
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{base}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{base}/labels.parquet").to_pylist()}
    ids = sorted(labels)[:2500]
    x, y = np.array([quality.features(docs[i]) for i in ids]), np.array([labels[i] for i in ids], float)
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in ids])
    model = quality.fit(x[fold != 0], y[fold != 0], fold[fold != 0] == 1)
    assert ((model.score(x[fold == 0]) >= 0.3) == y[fold == 0]).mean() > 0.97
