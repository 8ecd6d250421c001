import base64
import collections
import os
import random

from codeassay.llm import quality
from odd_rows import TEXTS, no_documents, odd_documents, rows, words


def counts(text):
    own, cover = words(text), set()
    seen = collections.Counter(zip(own, own[1:], own[2:]))
    for i in range(len(own) - 2):
        if seen[tuple(own[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_counts_of_odd_rows(spark):
    texts = [*TEXTS, (20, "a a a a a"), (21, "# % b\n# % b\n# %\n\n"), (22, "r s t u r s t v")]
    found = rows(quality.with_quality(odd_documents(spark, texts)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    expected = []
    for i, x in texts:
        c = counts(x)
        expected.append((i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert found == sorted(expected, key=repr)
    assert quality.with_quality(no_documents(spark)).count() == 0


def test_bands(spark):
    rng = random.Random(2)
    plain = " ".join("".join(rng.choice(("th", "er", "on", "an", "re")) for _ in range(rng.randint(1, 4))) for _ in range(2500))
    noise = " ".join(os.urandom(8).hex() for _ in range(600))
    # Different words in every window, but the same letters again and again.
    loop = " ".join(f"{'abcdefgh' * 12}{i}" for i in range(400))
    mixed = plain[:6000] + " " + loop[:30000]
    texts = [(1, plain), (2, noise), (3, loop), (4, mixed)]
    found = {r["doc_id"]: r for r in quality.with_quality(odd_documents(spark, texts)).collect()}
    assert not any(r["base_failed"] for r in found.values())
    assert [found[i]["kept"] for i in (1, 3, 4)] == [True, False, False]
    assert found[4]["chunks_outside"] > 0.5 and found[1]["chunks_outside"] == 0
    assert quality.Bands(by_bytes=((0, 3.0, 9.0),)).of(5) == (3.0, 9.0)
    strict = quality.with_quality(odd_documents(spark, texts), bands=quality.Bands(by_bytes=((0, 2.5, 4.0),))).collect()
    assert not {r["doc_id"]: r for r in strict}[2]["kept"]


def test_all_columns_stay_and_new_names_win(spark):
    docs = odd_documents(spark)
    out = quality.with_quality(docs)
    assert out.columns == [*[c for c in docs.columns if c != "kept"], *(x.split()[0] for x in quality.COLUMNS.split(", "))]
    assert dict(out.dtypes)["kept"] == "boolean"


ENGLISH = """The harbour master kept two books, one for the ships that came in and another for those that were expected and did not
come. Nobody but him read the second book, though everyone in the town knew of it, and in bad winters the wives of the fishermen would
stand at his window and look at his face, not at the page. He wrote slowly, with a steel pen, and when the ink froze he warmed it over the
lamp. On the night of the great storm he filled four pages, and in the morning he had to strike out only three lines. The other names
stayed as they were, and when he died, his daughter carried on with the book, because somebody had to. She added a column for the weather,
and later one for the cargo, so that in the end the book said more about the town than the church register did. Strangers who asked for
it were told that it had been lost in the flood, which was not true. It lay under the counter, wrapped in oilcloth, and every year on the
first of November she took it out, read one page aloud to whoever was in the room, and put it back. The schoolmaster once proposed to have
it printed, but the council refused: a printed list would be finished, they said, and this one was not. So the last entry is in pencil,
without a date, and gives the name of a boat that nobody remembers having built."""
CHINESE = """港口的管理员有两本簿子，一本记着进港的船，另一本记着应该回来却没有回来的船。除了他自己，没有人看过第二本簿子，可是镇上的人都知道它。
冬天天气不好的时候，渔民的妻子们站在他的窗前，看他的脸色，而不看簿子。他写得很慢，用的是一支钢笔，墨水冻住了，就在灯上烤一烤。
大风暴的那天夜里，他写满了四页，到了早上只划掉了三行。其他的名字都留在那里。他去世以后，他的女儿接着写这本簿子，因为总得有人来写。
她加了一栏写天气，后来又加了一栏写货物，所以到了最后，这本簿子比教堂的记录更能说明这个镇子的事情。外面来的人问起这本簿子，
镇上的人就说它在洪水里丢了，其实不是这样。它放在柜台下面，用油布包着，每年十一月的第一天，她把它拿出来，给屋里的人念一页，然后放回去。
学校的老师曾经提议把它印出来，可是镇上的议会没有同意：印出来的名单就是写完了的，他们说，而这一本还没有写完。"""
RUSSIAN = """Смотритель гавани вёл две книги: одну для кораблей, которые пришли, и другую для тех, которых ждали и которые не пришли. Кроме него,
никто не читал вторую книгу, хотя все в городе о ней знали, и в плохие зимы жёны рыбаков стояли у его окна и смотрели ему в лицо, а не на
страницу. Он писал медленно, стальным пером, и когда чернила замерзали, он грел их над лампой. В ночь большой бури он исписал четыре
страницы, а утром ему пришлось вычеркнуть только три строки. Остальные имена так и остались, и когда он умер, его дочь стала вести книгу
дальше, потому что кто-то должен был это делать."""


def random_letters(n, seed):
    """Noise as hexadecimal words, base64 in lines and in words, and digits, of n bytes each."""
    rng = random.Random(seed)
    b64, hexed = base64.b64encode(rng.randbytes(n)).decode(), rng.randbytes(n).hex()
    cut = lambda s, w, by: by.join(s[i : i + w] for i in range(0, n, w))[:n].encode()
    return [cut(hexed, 16, " "), cut(hexed, 8, " "), cut(b64, 76, "\n"), cut(b64, 9, " "), cut("".join(rng.choices("0123456789", k=n)), 7, " ")]


def test_encoded_noise_is_no_prose(spark):
    judge = quality._Ratios(quality.Bands()).judge
    for n in (1024, 1500, 2047, 2048, 3000, 4095, 4096, 8192, 20_000, 50_000):
        for seed in range(10):
            assert not any(judge(x)[-1] for x in random_letters(n, seed)), (n, seed)
    for prose in (ENGLISH, CHINESE, RUSSIAN):
        data = prose.encode()
        assert judge(data)[-1] and judge(data[:1024])[-1]
        # As many different characters of the script, without a language.
        drawn = "".join(random.Random(3).sample(prose, len(prose))).encode()
        assert not judge(drawn)[-1]
    assert judge(ENGLISH[:300].encode())[-1]
    assert quality._Ratios(quality.Bands()).gain(b"\x80" * 1100, 9.0) == 0
    noise = [(i, x.decode()) for i, x in enumerate(random_letters(4000, 4))]
    found = {r["doc_id"]: r for r in quality.with_quality(odd_documents(spark, [*noise, (9, ENGLISH)])).collect()}
    assert not any(r["base_failed"] for i, r in found.items() if i != 2)
    assert [found[i]["kept"] for i in (0, 1, 2, 3, 4, 9)] == [False] * 5 + [True]


def test_chunks_of_every_longer_text_to_its_end():
    judge = quality._Ratios(quality.Bands()).judge
    rng = random.Random(7)
    prose = lambda n: " ".join("".join(rng.choice(("th", "er", "on", "an", "re", "il", "os", "ma")) for _ in range(rng.randint(1, 4))) for _ in range(n))[:n].encode()
    loop = lambda n: " ".join(f"{'abcdefgh' * 12}{i}" for i in range(n))[:n].encode()
    noise = lambda n: random_letters(n, 8)[0]
    for junk in (loop, noise):
        # Two chunks, the second of them junk; the end of three; exactly half.
        for good, bad in ((4096, 3900), (8192, 4000), (8192, 3800), (20_480, 20_480), (20_000, 20_000)):
            assert not judge(prose(good) + junk(bad))[-1], (junk, good, bad)
    for n in (4096, 4097, 5000, 8191, 8192, 8193, 12_000, 50_000):
        assert judge(prose(n))[-1]
        assert (judge(prose(n))[3] is None) == (n <= 4096)
    for n in (4097, 6000, 8191):
        assert not any(judge(x)[-1] for x in random_letters(n, 9))
    # One odd chunk of many is let through.
    assert judge(prose(20_480) + loop(4096) + prose(20_480))[-1]


def test_repetition_that_no_window_shows(spark):
    """Lines from one mould with another number in every third word: no three words occur twice, and the text says one thing."""
    rng = random.Random(6)
    line = lambda: f"{rng.randrange(10**4)} crates of {rng.randrange(10**4)} pears for {rng.randrange(10**4)} days at {rng.randrange(10**4)} cents"
    texts = [(i, "\n".join(line() for _ in range(n))) for i, n in enumerate((15, 30, 60, 150, 600))] + [(10, ENGLISH), (11, RUSSIAN), (12, CHINESE + " " + ENGLISH)]
    found = {r["doc_id"]: r for r in quality.with_quality(odd_documents(spark, texts)).collect()}
    assert not any(r["base_failed"] for r in found.values())
    assert [found[i]["kept"] for i in (0, 1, 2, 3, 4, 10, 11, 12)] == [False] * 5 + [True] * 3
    assert quality.letters_a_byte("aя日😀".encode()) == 0.4


def test_large_scripts_are_not_taken_for_repetition():
    """Two and three bytes a letter compress better and may: the upper end counts letters."""
    judge = quality._Ratios(quality.Bands()).judge
    rng = random.Random(1)
    for first, n in ((0x400, 60), (0x900, 60), (0x4E00, 300)):
        stems = ["".join(chr(first + rng.randrange(n)) for _ in range(2)) for _ in range(120)]
        text = " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(3000))
        for size in (300, 800, 1500, 3000, 6000):
            assert judge(text[:size].encode())[-1], (hex(first), size)
