"""Row-local operators against the libraries, plain searches and held-out rows."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from turnloom.llm import decontam
from turnloom.llm.blocks import main_text
from turnloom.llm.bpe import bpe, encode, round_trip
from turnloom.llm.decontam import Templater, _emit, _targets, contaminated
from turnloom.llm.langid import language_ids
from turnloom.llm.licenses import TEMPLATES, scan_licenses
from turnloom.llm.secrets import Scanner, Span, checksum, find_secrets
from turnloom.llm.sharding import borders, keyed, shard, write_shards
from turnloom.llm.token_counts import count_tokens, counter

SF = "/root/testdata/sf0.001"
PIECES, WORDS = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "word_bpe_49k.json"))
DOCS = "doc_id long, text string, lang string, n_tokens string, shard int"


def odd_texts():
    rnd = random.Random(3)
    letters = "ab  \n▁éẞ'stlethn你<|end>_AΣİ\t1²½😀"
    fixed = [None, "", " ", "  a  b ", "\n", "a\n\nb", "①ﬁ İ ΑΣ", "a▁b", "x" * 3000, "<|endoftext|>hi", "é", "日本語 한국어 12"]
    return fixed + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 120))) for _ in range(400)]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "x", 1) for k, t in enumerate(texts)], DOCS)


def test_token_counts_are_the_library_s(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = odd_texts()
    got = {r["doc_id"]: tuple(r)[1:] for r in count_tokens(frame(spark, texts), PIECES, limit=50).collect()}
    for k, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert got[k] == (len((t or "").encode()), n, n > 50)
    with open(PIECES, "rb") as file:
        machine = counter(file.read())
    assert all(machine.count(t, chunk=7) == machine.count(t) for t in texts)
    assert count_tokens(frame(spark, []), PIECES).collect() == []


def test_ids_and_decoding_are_the_library_s(spark):
    library = tokenizers.Tokenizer.from_file(WORDS)
    texts = odd_texts()
    ids = {r["doc_id"]: r["ids"] for r in encode(frame(spark, texts), WORDS).collect()}
    digests = {r["doc_id"]: r for r in round_trip(frame(spark, texts), WORDS).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for k, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids[k] == want
        assert digests[k]["ids_sha256"] == sha(" ".join(map(str, want)))
        assert digests[k]["decoded_sha256"] == sha(library.decode(want, skip_special_tokens=False))
    with open(WORDS, "rb") as file:
        machine = bpe(file.read())
    words = [w for t in texts if t for w in machine.split.findall(machine.normal(t))]
    assert max(machine.machine.waiting(machine.symbols(w)) for w in words) <= machine.lookahead
    assert "".join(machine.text(machine.encode("Hello Wörld 日本"))) == "hello wörld 日本 "
    for t in [*filter(None, texts), " \t\x1c\x85\u3000 a\x00'S \xa0b's1²ΣİA\u0301\n", "\x7f \u200b!\u2028x"]:
        assert machine.words(t) == machine.split.findall(machine.normal(t))


def test_spans_equal_a_plain_search(spark):
    rnd = random.Random(1)
    bits = ["password", "TOKEN", "apiKey", "api_key", "secret", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGHIJKLMNOPQ"]
    bits += ["abcdef0123", "0123456789abcdef", "é", "İ", "passwd", "x"]
    for _ in range(1500):
        text = "".join(rnd.choice(bits) for _ in range(30))
        pattern = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        want = [Span(m.start(), 0, m.end()) for m in re.finditer(pattern, text) if len(m[2]) >= 6]
        want += [Span(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [Span(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert [s for s in Scanner().scan(text) if s.rank < 3] == sorted(want)
    good = "ghp_" + "A" * 30 + checksum("A" * 30)
    assert Scanner().scan(f"é {good}!") == [Span(2, 3, 42)]
    assert Scanner().scan(f"{good[:-1]}{'1' if good[-1] != '1' else '2'}") == []
    assert Scanner().redact('a token = "abcdefgh" b') == 'a [secret]" b'
    rows = find_secrets(frame(spark, [None, "", "secret: hunter22"])).orderBy("doc_id").collect()
    assert [r["spans"] for r in rows] == ["", "", "assign:0:16"]


def test_licenses_equal_a_plain_search(spark):
    texts = [None, "", "Released UNDER the MIT-License.", "apache license, version 2; Apache License Version 2"]
    texts += ["CC BY-NC cc by nd", "under the mit", "GNU General Public License, version 3.", "x " * 30000 + "cc by nc"]
    for r in scan_licenses(frame(spark, texts)).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[r["doc_id"]] or "").lower())
        at = [(k, t) for t in TEMPLATES for k in range(len(words)) if tuple(words[k : k + len(t.words)]) == t.words]
        base = [(k, t.label) for k, t in at if t.base]
        assert r["n_words"] == len(words) and r["n_base"] == len(base)
        assert r["first_word"] == min((k for k, _ in base), default=None)
        assert r["last_word"] == max((k for k, _ in base), default=None)
        assert r["base_labels"] == ",".join(sorted({label for _, label in base}))
        assert r["labels"] == ",".join(sorted({t.label for _, t in at}))
        assert r["score"] == (1.0 if at else 0.0)


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_ids(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 100 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    got = language_ids(frame(spark, [None, "", "12 !", "the"])).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got[:3]] == ["und"] * 3
    assert language_ids(frame(spark, [])).collect() == []


def test_main_text_of_given_and_other_pages():
    for (page,) in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall():
        article = re.search("<article>(.*?)</article>", page, re.S)[1]
        blocks = re.findall("<(?:h1|p)>(.*?)(?=</h1>|</p>|<p>|$)", article, re.S)
        texts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in blocks]
        assert main_text(page) == "\n".join(t for t in texts if t)
    page = (
        "<body><header>Site</header><div id='cookie-notice'>We use</div><div class=content><h2>A  title</h2>"
        "<p>First &amp; long enough text of the page.<p>Be.</div><aside>More</aside>"
        "<div class='comments'><p>Nice post, thank you all!</p></div><form><p>Name</p></form></body>"
    )
    assert main_text(page) == "A title\nFirst & long enough text of the page.\nBe."
    assert main_text(None) == main_text("") == main_text("<nav><a>x</a></nav>") == ""


def test_main_text_keeps_all_lines_of_an_article():
    links = "".join(f"<li><a href='/{k}'>Reference {k}</a></li>" for k in range(6))
    page = (
        "<body><nav><a href='/'>Home</a></nav><p>Some teaser</p><article><h1><a href='/t'>The title</a></h1>"
        "<p class='alert'>Mind the step.</p><h2 id='related-work'>Related work</h2><p>They did it.</p>"
        "<section id='search-trees'><h2>Trees</h2><div class='tags'>balanced, binary</div></section>"
        f"<p>As before.</p><ol>{links}</ol><p>Middle.</p><ol>{links}</ol>"
        "<div class='share-buttons'>Tweet</div><div id='comments'><p>Nice!</p></div><div class='box comment-list'>Me too</div>"
        "<form>Name</form><ul class='nav'><li>Next</li></ul></article><footer>Site</footer></body>"
    )
    refs = [f"Reference {k}" for k in range(6)]
    want = ["The title", "Mind the step.", "Related work", "They did it.", "Trees", "balanced, binary", "As before."]
    assert main_text(page).split("\n") == [*want, *refs, "Middle.", *refs]
    text = "<p>Enough text of the page to be its main part.</p>"
    assert main_text(f"<body><h1><a href='/t'>The title</a></h1>{text}<h2 id='related-work'>Related</h2>{text}</body>").split("\n") == [
        "The title", text[3:-4], "Related", text[3:-4]
    ]
    menu = "".join(f"<li><a href='/{k}'>Menu {k}</a></li>" for k in range(9))
    assert main_text(f"<body><ul>{menu}</ul><hr><div class='site-nav'>x</div>{text}<div id='site-footer'>y</div></body>") == text[3:-4]


def test_shards_hold_about_equal_bytes(spark):
    texts = [None, "", *["hot " * 20] * 700, *[f"text {k} " * (k % 40) for k in range(1400)], "é" * 900]
    rows = shard(frame(spark, [*texts]).union(frame(spark, ["same"] * 3)), shards=24).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    expected = sorted((k, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for k, t in [*enumerate(texts), *enumerate(["same"] * 3)])
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)
    assert {r["law"] for r in rows} == {"bytes"} and set(sizes) == set(range(24))
    for k in range(24):
        own = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert own == list(range(len(own)))
    assert shard(frame(spark, [])).collect() == []


def test_borders_are_in_order_and_split_exactly(spark):
    """Against the places themselves, with a group of equal texts across several shards."""
    texts = ["hot text of all " * 30] * 900 + [f"text {k} " * (k % 50) for k in range(900)]
    rows = keyed(frame(spark, texts), "doc_id", "text")
    places = sorted((r["place"], r["size"]) for r in rows.select("place", "size").collect())
    total, largest = sum(size for _, size in places), max(size for _, size in places)
    for shards, parts in ((5, 4), (24, 4), (3, 100)):
        found, end = borders(rows, shards, parts, 0.0005)
        assert len(found) == shards * parts - 1 and found == sorted(found) and (end.bytes, end.rows) == (total, len(places))
        for k, border in enumerate(found):
            below = [size for place, size in places if place < border.key]
            assert (sum(below), len(below)) == (border.bytes, border.rows)
            if (k + 1) % parts == 0:
                assert abs(border.bytes - total * (k + 1) / shards / parts) <= max(0.0005 * total / shards, largest)


def test_shards_hold_the_whole_rows(spark, tmp_path):
    texts = [None, "", *[f"text {k % 300} " * (k % 40) for k in range(900)]]
    df = frame(spark, texts).union(frame(spark, [None, "again", "again"])).repartition(3)
    write_shards(df, f"{tmp_path}/shards", shards=5)
    rows = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert sorted((tuple(r["row"]) for r in rows), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    digests = {(r["shard"], r["slot"]): r for r in shard(df, shards=5).collect()}
    assert len(digests) == len(rows)
    for k in range(5):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(s == k for s, _ in digests)))
    plan = shard(df, shards=5)._jdf.queryExecution().optimizedPlan().toString()
    assert "crc32" in plan and "crc32" not in plan[plan.index("Window ") :]


def test_contaminated_documents(spark):
    item = "If Anna buys 12 apples for 3 dollars each and gives 12 to Bob how much money did Anna spend in total on the fruit"
    other = "the quick brown fox jumps over the lazy dog while seven sleepy cats watch from an old wooden fence nearby"
    bench = spark.createDataFrame([(1, item, 5), (2, other, 6), (3, None, 7), (4, "", 8)], "item_id long, text string, doc_id int")
    same = item.replace("Anna", "Mary").replace("12", "40").replace("3 dollars", "7 euros").replace("Bob", "John")
    clash = item.replace("12 apples", "40 apples").replace("gives 12", "gives 41")
    short = " ".join(other.split()[:9])
    texts = [None, "", f"Some text before. {item} and after.", f"Filler words here. {same}", f"Filler words here. {clash}", f"x {short} y", "clean " * 500, f"A\n{other.upper()}"]
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(frame(spark, texts), bench).collect()}
    assert got == {(2, 1), (3, 1), (7, 2)}
    assert contaminated(frame(spark, []), bench).collect() == []


def test_words_of_letters_are_not_looked_at_one_by_one(monkeypatch):
    seen, token = [], decontam.token
    monkeypatch.setattr(decontam, "token", lambda raw: (seen.append(raw), token(raw))[1])
    words = [f"{a}{b}ß{c}{m}" for a in "AaÉй" for b in "bBñ" for c in "xyz" for m in ("", ",", ".", "!")]
    found = Templater().canonical(" ".join([*words, "12", "mm", "don't"]) + "\n")
    assert seen == ["12", "don't"] and len(found.value) == len(words) + 3 and len(np.unique(found.value)) == 3 * 2 * 3 + 3
    assert found.kind[-3:].tolist() == [decontam.NUMBER, decontam.UNIT, decontam.WORD]


def test_tokens_are_those_of_single_words(monkeypatch):
    rnd = random.Random(9)
    chars = "aAbBéÉßẞσςΣİıǅªº²12.,;:!?\"'()$%*_|-–\t\r\x1c\u3000日本йЙ\u0301\u0307😀𐐀ﬁŉ" + " " * 12 + "\n" * 3
    texts = ["".join(rnd.choices(chars, k=rnd.randrange(90))) for _ in range(1500)]
    texts += [" ".join(rnd.choices(["ΟΔΟΣ.", "Miles", "5", "ok!", "(hello)", "Hello", "BERLIN,", "\n"], k=30)) for _ in range(200)]
    texts += [f"{q}{'a' * k}{m}" for k in (63, 64, 65) for m in ("", ".", "')") for q in ("", "'")] + ["", " ", "\n", " \n \n"]

    def word(code):
        return code - decontam.UNIT if code & 7 == decontam.UNIT else code

    for piece in (decontam.PIECE, 7):
        monkeypatch.setattr(decontam, "PIECE", piece)
        maker = Templater()
        for text in texts:
            got = [c for part in maker.pieces(text) for c in part.tolist()]
            want = [Templater._token(w) for w in text.replace("\n", " \n ").split(" ") if w]
            # Units are told from words by what stands before, later.
            assert [word(c) for c in got] == [word(c) for c in want], text


def test_contaminated_by_names_at_starts_and_other_case(spark):
    tom = "Tom has 5 apples and Ann has 3 pears. Ann gives Tom 2 apples. How many apples does Tom have now"
    anna = "If Anna buys 12 apples for 3 dollars each and gives 12 to Bob how much money did Anna spend in total on the fruit"
    short = "Tom walks 5 miles every day to the old school"
    items = [(1, tom), (2, anna), (3, short)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    sam = tom.replace("Tom", "Sam").replace("Ann", "Eve")
    texts = [sam, f"Some words. {sam.replace('5', '7')}", anna.lower(), anna.upper(), anna.lower().replace("3", "9")]
    texts += ["they say Sam walks 8 miles every day to the old school", f"x {short} y", short.replace("Tom", "He")]
    clash = tom.replace("Tom has 5", "Sam has 5").replace("gives Tom", "gives Max").replace("does Tom", "does Joe")
    texts += [clash, f"if so. {short}".lower(), "the old school is 5 miles from here and Tom walks"]
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(frame(spark, texts), bench).collect()}
    assert got == {(0, 1), (1, 1), (2, 2), (3, 2), (4, 2), (5, 3), (6, 3), (7, 3), (9, 3)}
    # A possible name that is none does not undo what matches without it.
    item = "The cat sat on the mat by the door of the barn all day. The dog ran off"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    row = contaminated(frame(spark, [item.replace("The cat", "A cat", 1)]), bench).first()
    assert (row["item_id"], row["n_windows"], row["n_words"]) == (1, 10, 17)
    # Of two possible names one is another name, one in small letters.
    item = "Yes it is. Tom has apples now"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert contaminated(frame(spark, ["so yes it is. Sam has apples now"]), bench).count() == 1


def test_contaminated_by_items_of_placeholders(spark):
    items = [
        "Sort these: 12, 7, 45, 3, 28, 19, 6, 31, 50, 2, 8",
        "Compute 12 * 34 + 56 / 7",
        "Anna Bob Carl Dora Emil Fred Gina Hugo Ida Jan Kim Lena Max Nora Otto",
        "Der Hund und die Katze im Haus am See sehen den Mond und die Sterne in der Nacht",
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [*items, *(f"some words {t} and more" for t in items), items[0].replace("45", "46"), items[1].replace("56", "57")]
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(frame(spark, texts), bench).collect()}
    assert got == {(k, k % 4) for k in range(8)}


def test_short_items_do_not_mark_every_text(spark):
    items = ["yes", "Compute 7", "What is the capital", "What is the capital of France", "Name it", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = ["He said yes and went home", "Compute 5 of them", "yes", "so what is the capital of spain or france", "Name It", "say: what is the capital of France", "Compute 9"]
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(frame(spark, texts), bench).collect()}
    assert {(2, 0), (4, 4), (5, 3), (6, 1)} <= got and not got & {(0, 0), (1, 1), (3, 2), (5, 2), (0, 4), (1, 4)}


def test_items_of_one_stem(spark):
    """Windows that many items share are joined once, and nothing changes in the result."""
    stem = "Which of the following statements about the matter is true"
    tail = "Choose the one answer that fits the text above best of all the four that are given here"
    rnd = random.Random(2)
    own = [" ".join(f"w{rnd.randrange(900)}x" for _ in range(12)) for _ in range(600)]
    items = [f"{stem} {own[k]}" for k in range(300)]  # ten shared words: no item is held by them
    items += [f"{own[k]}. {tail}" for k in range(300, 400)]  # all are held by the tail
    items += [f"Tom has {k} apples and Ann has {k + 1} pears for the way home today" for k in range(60)]
    items += [items[0], None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    bench = bench.union(bench.filter("item_id < 3")).union(bench.filter("item_id = 5").selectExpr("NULL", "text"))
    texts = [f"x {stem} {own[7]}", f"{stem} is asked here", f"{own[1]} {stem}", f"so. {tail}", f"{own[310]}. {tail}", f"a {own[305]} {tail[:30]}"]
    texts += ["They say Sam has 7 apples and Eve has 8 pears for the way home today", "Sam has 7 apples and Eve has 7 pears for the way home today", items[0], None, items[0]]
    docs = frame(spark, texts).select("doc_id", "text").union(spark.createDataFrame([(None, items[9]), (3, items[8])], "doc_id long, text string"))
    want = sorted(contaminated(docs, bench, common=1 << 30).collect(), key=repr)
    held = Counter(r["doc_id"] for r in want)
    assert held[3] == 101 and held[4] == 100 and held[6] == 60 and held[0] == held[None] == 1 and held[8] == 2 and not {1, 2} & {*held}
    for common in (0, 5, 64):
        assert sorted(contaminated(docs, bench, common=common).collect(), key=repr) == want
    items = [f"{stem} {own[k % 600]} {k}" for k in range(5000)]
    windows = _emit(spark.createDataFrame(list(enumerate(items)), "id long, text string"), "id", "text", [], None, True)
    names = {"id": "item", "n_words": "item_words", "at": "item_at", "slots": "item_slots", "loose": "item_loose"}
    targets, stems = _targets(windows.drop("text_hash").withColumnsRenamed(names), 64)
    assert targets.filter("stem IS NOT NULL").select("stem").distinct().count() == 1 and stems.count() == 5000


def test_contaminated_rows_that_repeat_and_lack_ids(spark):
    item = "the quick brown fox jumps over the lazy dog while seven sleepy cats watch from an old fence"
    bench = spark.createDataFrame([(1, item), (1, item), (None, item)], "item_id long, text string")
    rows = [(1, item, "a"), (1, item, "a"), (1, "other text", "b"), (None, item, "c"), (3, f"{'filler words ' * 20000}{item}", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item string").repartition(3)
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()}
    assert got == {(d, i) for d in (1, None, 3) for i in (1, None)}
    assert contaminated(docs, spark.createDataFrame([], "item_id long, text string")).collect() == []


@pytest.mark.parametrize("name", ["ids", "counts"])
def test_lookahead_is_positive(name):
    with open(WORDS, "rb") as file:
        assert bpe(file.read()).lookahead > 0
