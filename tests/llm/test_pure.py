"""The text operators' inner functions against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import zstandard

from plantwatch.llm import dedup_lines, html_text, packing, pii, quality, simhash, toxicity, warc

# personal data


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@pytest.mark.parametrize("alphabet", ["ab@@..1 -é+", "0123456789 -", "+1234567890 ().-", "12....@a"])
def test_base_spans(alphabet):
    r = random.Random(alphabet)
    for _ in range(5000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 30)))
        assert pii.detect(text) == brute_spans(text), text


def test_disguises_map_back():
    for text, kind, said in [
        ("mail jоhn [at] mail [dot] example [dot] com now", "email", "jоhn [at] mail [dot] example [dot] com"),
        ("john dot smith at mail dot example dot org", "email", "john dot smith at mail dot example dot org"),
        ("call plus four four two zero seven nine four six zero one two three ok", "phone", "plus four four two zero seven nine four six zero one two three"),
        ("at 10 dot 0 dot 0 dot 1 it is", "ip", "10 dot 0 dot 0 dot 1"),
        ("bosbt.42 at mail8.example.com", "email", "bosbt.42 at mail8.example.com"),
    ]:
        base, more = pii.find(text)
        assert [(text[a:b], k) for a, b, k in more] == [(said, kind)] and not base
    assert pii.find("The thing at hand. One two three dots") == ([], [])
    assert pii.find(None) == pii.find("") == ([], [])
    assert pii.redact_text("a@b.cd and 1.2.3.4") == "<email> and <ip>"


def test_at_disguises_without_digits():
    for local, before in [("jane.doe", ""), ("jane_doe", "ask "), ("jane+news", "so "), ("j4ne", "by "), ("jane", "mail "), ("jane", "Contact: "), ("jane", "write to "), ("us", "e-mail: "), ("a.b-c", "(")]:
        for at in (" at ", "  AT "):
            said = f"{local}{at}mail.example.com"
            text = f"{before}{said}, thanks"
            base, more = pii.find(text)
            assert not base and [(text[a:b], k) for a, b, k in more] == [(said, "email")], text
            assert pii.redact_text(text) == f"{before}<email>, thanks"
    for text in ("look at example.com", "It ended. We met at example.com", "contact us at example.com", "the contact page at example.com", "mail me at example.com", "- at example.com"):
        assert pii.find(text) == ([], []), text


@pytest.mark.parametrize("unit", ["jane.doe at example.com, ", "john dot smith at mail dot example dot org; ", "a.b@c.de ", "jоhn@mail.example.com ", "10 dot 0 dot 0 dot 1 ", "one two three four five, ", "+1 (269) 555-3296 ", "4111 1111 1111 1111; ", "dot ", " at ", "a-", "x at y.", "mail [at] ", "1 2 one ", "a.", "a@", "@", "一"])
def test_time_grows_with_the_matches(unit):
    import time

    def took(n):
        start = time.process_time()
        pii.find("é ｱ " + unit * n)
        return time.process_time() - start

    took(100)
    assert took(32_000) < 8 * max(took(8_000), 0.05) + 0.2  # four times as much; squares would take sixteen


def test_disguises_of_any_depth():
    host = ".".join(["a1"] * 40) + ".example.com"
    assert [k for _, _, k in pii.find(f"jane.doe at {host} now")[1]] == ["email"]
    assert [k for _, _, k in pii.find(f"jane at {host.replace('.', ' dot ')} now")[1]] == ["email"]


def test_long_text_is_linear():
    assert pii.find("1" * 200_000)[0] == [] and pii.find("a." * 100_000)[0] == []


# quality


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(marked)}


def test_quality_measures():
    r, z = random.Random(7), zstandard.ZstdCompressor()
    for _ in range(1500):
        text = "".join(r.choice(["a", "b", "é", " ", " ", "\n", "\t", "#", "\x1c", "\x85", "\xa0", "ab c", "\x0b"]) for _ in range(r.randint(0, 40)))
        got = quality.measure(text, z)
        assert {k: got[k] for k in brute_quality(text)} == brute_quality(text), repr(text)
        assert got["base_failed"] and not got["kept"]
    assert quality.measure(None, z)["n_words"] == 0


def test_quality_bands():
    z, r = zstandard.ZstdCompressor(), random.Random(1)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(400)]
    prose = " ".join(r.choice(words) for _ in range(3000))
    assert quality.measure(prose, z)["kept"]
    noise = " ".join("".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60)) for _ in range(400))
    assert quality.measure(noise, z)["reason"] == "incompressible"
    slow = " ".join(f"{w} {i % 7}" for i, w in enumerate(words[:50] * 2)) + "=" * 30_000
    assert quality.measure(slow, z)["reason"] == "repetitive"


def test_short_noise_is_told_from_short_prose():
    z, r = zstandard.ZstdCompressor(level=quality.LEVEL), random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    prose = re.sub(r"\s+", " ", (quality.__doc__ + simhash.__doc__ + warc.__doc__))
    for n in (249, 299, 350, 399, 430, 480, 560, 659, 760, 899, 1200, 1559, 1949):
        k = n // 50 - 1
        for _ in range(20):
            noise = " ".join("".join(r.choice(letters) for _ in range(k)) for _ in range(n))[:n]
            got = quality.measure(noise, z)
            assert got["n_words"] >= 50 and got["reason"] == "incompressible", (n, got["ratio"])
        if n >= 399:
            assert quality.measure(prose[:n], z)["kept"], n


def test_chunks_of_noise_in_prose():
    z, r = zstandard.ZstdCompressor(level=quality.LEVEL), random.Random(4)
    word = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    words = [word("abcdefghijklmnopqrstuvwxyz", r.randint(2, 8)) for _ in range(2000)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))[: n - 1] + "\n"
    noise = lambda n: " ".join(word("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 60) for _ in range(n // 61 + 1))[: n - 1] + "\n"
    for n in (4097, 5000, 30_000, 400_000):
        assert quality.measure(prose(n), z)["kept"]
    size = quality.CHUNK
    for text in (prose(7 * size) + noise(5 * size), prose(3 * size) + noise(size), prose(2 * size + 100) + noise(size), prose(90 * size) + noise(4 * size) + prose(90 * size)):
        got = quality.measure(text, z)
        assert got["reason"] == "chunks" and not got["kept"], (len(text), got["ratio"], got["chunks_outside"])


# fingerprints


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    import xxhash

    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    r = random.Random(3)
    for _ in range(500):
        text = "".join(r.choice(["a", "B", "É", " ", "\n", "cd ", "\x85", "\x1c"]) for _ in range(r.randint(0, 40)))
        assert simhash.fingerprint(text) == brute_fingerprint(text), repr(text)
    assert simhash.fingerprint(None) == 0


@pytest.mark.parametrize("bits", [list(range(64)), list(range(0, 64, 2)), list(range(40, 56))])
def test_masks_cover_every_difference_within_the_radius(bits):
    family, r = simhash.masks(bits), random.Random(5)
    for _ in range(20_000):
        difference = sum(1 << b for b in r.sample(bits, r.randint(1, simhash.RADIUS)))
        assert any(not m & difference for m in family)


def test_forest_connects_like_all_pairs():
    r = np.random.default_rng(2)
    values = np.unique(np.concatenate([r.integers(0, 2**64, 30, dtype=np.uint64), np.uint64(5) ^ (np.uint64(1) << r.integers(0, 64, 60, dtype=np.uint64))]))
    group = {int(v): int(v) for v in values}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in simhash._forest(values, 4):
        assert (a ^ b).bit_count() <= 4
        group[root(a)] = root(b)
    for a in map(int, values):
        for b in map(int, values):
            assert (a ^ b).bit_count() > 4 or root(a) == root(b)


# packing


def test_encoder_gives_the_tokenizers_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    ours, theirs, r = packing.Encoder(path), Tokenizer.from_file(path), random.Random(0)
    parts = [*"'sdtrevelm  \n\n\tab1²é_-#.Ø×ſ\r½漢😀\x1c\x85\xa0|<endoftext>", "<|endoftext|>", " " * 5000, "\n " * 3000]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert ours.text(text).tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("unit", [" ", "\n", "\t \n", "a", "1", "-", "漢", "ab ", " <|endoftext|>"])
def test_encoder_takes_long_texts_of_one_kind(unit):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    ours = packing.Encoder(path)
    text = unit * (20_000 // len(unit))
    assert ours.text(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    long = unit * (2_000_000 // len(unit))
    ids = ours.text(long)
    assert b"".join(ours.model.decode_single_token_bytes(i) if i != 50256 else b"<|endoftext|>" for i in ids.tolist()).decode() == long


def test_cuts():
    assert packing.cuts(1024) == [(0, 1024)] and packing.cuts(1) == [(0, 1)]
    assert packing.cuts(1025) == [(0, 1), (1, 1024)] and packing.cuts(2048) == [(0, 1024), (1024, 1024)]


def test_best_fit_takes_the_fullest_bin_that_fits():
    r = random.Random(4)
    for _ in range(300):
        lengths = sorted((r.randint(1, 50) for _ in range(r.randint(1, 60))), reverse=True)
        rooms, want = [], []
        for n in lengths:
            fits = [i for i, x in enumerate(rooms) if x >= n]
            b = min(fits, key=lambda i: rooms[i], default=None)
            if b is None:
                rooms.append(50)
                b = len(rooms) - 1
            want.append(rooms[b] - n)
            rooms[b] -= n
        got, left = packing.best_fit(lengths, 50), {}
        seen = []
        for n, b in zip(lengths, got, strict=True):
            left[b] = left.get(b, 50) - n
            seen.append(left[b])
        assert seen == want


# pages


def learned():
    pages = [f"<html><head><title>t</title></head><body><nav><ul><li><a>x</a></li></ul></nav><div class='ad'>buy it</div><article><h1>One {i}</h1><p>some words that make a text</p></article><footer>f</footer></body></html>" for i in range(3)]
    counts = {}
    for p in pages:
        for s, n, inside in html_text.label(p):
            counts[s, inside] = counts.get((s, inside), 0) + n
    return html_text.learn(counts)


def test_main_text():
    s = learned()
    assert html_text.extract("<nav>a b c</nav><article><h1>A &amp; b</h1><p>one <b>two</b>\n three<p>four<br>five<script>var t='</p>'</script></article><footer>x</footer>", s) == "A & b\n\none two three\n\nfour five"
    for empty in (None, "", "<nav>menu</nav>", "<p></p>", "<!-- x", "<"):
        assert html_text.extract(empty, s) in ("", "<")
    assert html_text.extract("<main><p>words here</p><div class='comments'>nice post</div><form>mail</form><aside>also</aside><p>more words</p></main>", s) == "words here\n\nmore words"
    assert html_text.extract("plain words only", html_text.Scores()) == "plain words only"


@pytest.mark.parametrize("page, text", [
    ('<div class="page has-sidebar"><article><h2 class="section-header">Head</h2><p>text of <math>x+1</math> words</article></div>', "Head\n\ntext of x+1 words"),
    ("<a title=don't>link</a> words here and it's more", "link words here and it's more"),
    ('<div class="sidebar"><p>only words here</p></div>', "only words here"),
    ("<form id=aspnet><div><p>all of it is in a form</p></div></form>", "all of it is in a form"),
    ("<p>hello there you all <b class=ad>x y</b> fine</p><div id=comments>bla bla</div>", "hello there you all\n\nfine"),
    ("<p>1 < 2 and 3 > 2 <!-- no --> ok</p>", "1 < 2 and 3 > 2 ok"),
    ('<p>one two one two <a href="x>three four</a> five six seven eight</p>', "one two one two three four five six seven eight"),
    ("<ARTICLE><P>loud words</P><DIV CLASS='Comment-List'>nice</DIV></ARTICLE><FOOTER>f</FOOTER>", "loud words"),
    ("<body class='sidebar-left menu'><p>words in the body</p></body>", "words in the body"),
    ("<p>seen <span hidden>not seen</span> again</p><p style='display: none'>gone</p>", "seen\n\nagain"),
    ("<table><tr><td>a b c d e f g h<td>b c d e f g h i<tr><td>c d e f g h i j k l</table>", "a b c d e f g h\n\nb c d e f g h i\n\nc d e f g h i j k l"),
    ("x" * 5 + "<script>if (a < b) '</p>'</script>" + "y", "xxxxxy"),
])
def test_pages_that_disagree(page, text):
    assert html_text.extract(page, html_text.Scores()) == text


def test_scan_and_names_each_decide():
    farm = "<div>" + "".join(f"<a href=/{i}>go</a>" for i in range(30)) + "</div>"
    page = f"{farm}<p>{'some words of the story ' * 5}</p><div class=advert>buy now</div><p>{'and some more words ' * 5}</p>{farm}"
    for scores in (html_text.Scores(), learned()):
        assert html_text.read(page, scores).split("\n\n") == [("some words of the story " * 5).strip(), ("and some more words " * 5).strip()]
        assert "go" in html_text.read(page, scores, scan=False) and "buy now" in html_text.read(page, scores, html_text.MEANT)


def test_names_are_learned():
    page = lambda i: f"<div class=teaser>read this too, it is new</div><div class=sidebar><article><p>words of the story {i}</p></article></div>"
    counts = {}
    for i in range(40):
        for s, n, inside in html_text.label(page(i)):
            counts[s, inside] = counts.get((s, inside), 0) + n
    scores = html_text.learn(counts)
    assert scores.names["teaser"] < html_text.OUT < html_text.Scores().of_name("teaser")
    # here the story is in what is called a sidebar
    assert scores.names["sidebar"] > html_text.OUT > html_text.Scores().of_name("sidebar")
    assert html_text.extract("<div class=teaser>read on</div><div class=sidebar><p>a story</p></div>", scores) == "a story"


@pytest.mark.parametrize("unit", ["<font>", "<div>", '<a title="x> ', "<a b='c ", "<p>", "<", "<!--", "</div>", "<span class=ad>", '<li class="a', "a=\"", "<title>", "<div class=ad><b>"])
def test_parsing_time_grows_with_the_page(unit):
    import time

    def took(n):
        start = time.process_time()
        html_text.extract(unit * n, html_text.Scores())
        return time.process_time() - start

    took(100)
    assert took(40_000) < 8 * max(took(10_000), 0.05) + 0.2  # four times as much; squares would take sixteen


def test_best_region_against_all_regions():
    r = random.Random(6)
    for _ in range(500):
        x = [r.choice([-3, -1, 1, 2]) for _ in range(r.randint(0, 12))]
        a, b = html_text.best_region(x)
        assert sum(x[a:b]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1))])


# archives


def test_loser_tree():
    r = random.Random(8)
    for _ in range(1000):
        runs = [sorted((r.randint(0, 9), r.randint(0, 3)) for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 9))]
        assert list(warc.LoserTree(runs)) == sorted(x for q in runs for x in q)


def test_records_are_walked_by_length():
    import gzip

    body = "x\r\n\r\nWARC/1.1\r\né".encode()
    data = b"".join(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in (body, b"", body * 50))
    for size in (1, 2, 3, 7, 10_000):
        found = list(warc.parse(data[i : i + size] for i in range(0, len(data), size)))
        assert [b for _, _, b in found] == [body, b"", body * 50] and all(data[at:].startswith(b"WARC/1.1\r\n") for at, *_ in found)
    packed = memoryview(gzip.compress(data) + gzip.compress(data))
    for piece in (1, 5, 1 << 20):
        assert b"".join(warc.unpacked(packed, piece)) == data * 2
    for broken in (data[:-1], data[:30], b"x" + data):
        with pytest.raises(ValueError):
            list(warc.parse([broken]))
    assert warc.url_key("http://www.a.example.com/P?q=1#x") == "com,example,a)/p?q=1" and warc.url_key("") == ")/"


# units, labels


def test_units():
    text = "One two three four five six seven eight. Nine!\nshort\n  A B C D E F G H I \n...\n\nlast"
    of = lambda *kinds: [(text[a:b], (j - i) / 2) for a, b, i, j, _, _ in dedup_lines.units(text, kinds)]
    assert of("sentence") == [("One two three four five six seven eight.", 8), ("A B C D E F G H I", 9)]
    assert of("line") == [("One two three four five six seven eight. Nine!", 9), ("short", 1), ("A B C D E F G H I", 9), ("last", 1)]
    assert of("paragraph") == [(text[: text.index("\n\n")], 19), ("last", 1)]
    same = [next(dedup_lines.units(t, ["sentence"]))[4:] for t in ("one  TWO three, four five six seven eight.", text)]
    assert same[0] == same[1]
    assert list(dedup_lines.units("")) == [] == list(dedup_lines.units(" \n.\n"))


@pytest.mark.parametrize("alphabet", ["ab_1 \n.-", "aéß\u0130 \n\u0301.x", "ab \u4e2d\u6587\u3002\n"])
def test_words_lie_where_they_are_read(alphabet):
    r = random.Random(alphabet)
    for _ in range(400):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        found = dedup_lines.Words(text)
        assert [text[a:b].lower() for a, b in zip(found.starts.tolist(), found.ends.tolist(), strict=True)] == found.words
        if found.spaced:
            assert len(found.words) == len(re.findall(r"\w+", text)) and found.before[-1] == 2 * len(found.words)
        for a, b, i, j, *_ in dedup_lines.units(text):
            assert text[a:b] == text[a:b].strip() and 0 <= i < j <= found.before[-1]


def test_label_model_finds_accuracies():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.2
    votes = np.column_stack([np.where(r.random(4000) < p, np.where(y, 1, -1), np.where(y, -1, 1)) * (r.random(4000) < 0.7) for p in (0.9, 0.8, 0.75, 0.6)] + [np.zeros(4000, int)])
    votes[:, 4] = votes[:, 3]  # one voter repeats another
    q, table, corr, keep = toxicity.label_model(votes, 0.2)
    acc = [table[j, 1, 2] / (table[j, 1, 0] + table[j, 1, 2]) for j in range(5)]
    assert acc[0] > acc[1] > acc[3] and abs(acc[0] - 0.9) < 0.1
    assert corr[3, 4] > 0.9 and keep[4] < 0.6 < keep[0]
    assert ((q > 0.5) == y).mean() > 0.88


def test_hand_labels_calibrate_and_are_no_votes():
    r = np.random.default_rng(2)
    y = (r.random(3000) < 0.2).astype(int)
    right = (0.95, 0.85, 0.8, 0.7)
    votes = np.column_stack([np.where(r.random(3000) < p, 2 * y - 1, 1 - 2 * y) * (r.random(3000) < 0.8) for p in right]).astype(int)
    q, table, _, _ = toxicity.label_model(votes, 0.2, y)
    for j, p in enumerate(right):
        assert abs(table[j, 1, 2] / (table[j, 1, 0] + table[j, 1, 2]) - p) < 0.12
    # rows with equal votes have equal posteriors, whatever was said of them by hand
    seen = {}
    for v, x in zip(map(tuple, votes.tolist()), q.tolist(), strict=True):
        assert abs(seen.setdefault(v, x) - x) < 1e-12
    assert ((q > 0.5) == y).mean() > 0.9


def test_voters_of_lexicons_counts_and_patterns():
    x = np.array([[1, 1, 0], [0, 0, 1], [0, 0, 0]])
    votes, titles = toxicity.voters(x, ["=ab", "=cd", "abcd"], np.array([[1, 0, 0, 0, 0]] + [[0] * 5] * 2))
    said = {t: votes[:, i].tolist() for i, t in enumerate(titles)}
    assert said["word lexicon 0"] == [1, 0, 0] and said["word 2 times"] == [1, 0, 0] and said["word none"] == [0, -1, -1]
    assert said["stem 4 lexicon 0"] == [0, 1, 0] and said["stem 4 none"] == [-1, 0, -1] and said["shout"] == [1, 0, 0] and "stem 5 none" not in said


def test_hash_of_spans_is_of_code_points():
    text = "😀 a@b.cd"
    assert pii.detect(text) == [(2, 8, "email")]
    assert hashlib.sha256(pii.write_spans(pii.detect(text)).encode()).hexdigest() == hashlib.sha256(b"email:2:8").hexdigest()
