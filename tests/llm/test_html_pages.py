"""Pages that no generator made: plain layouts, inline elements inside a block, what has to go and what has to stay."""

import pytest

from tidemark.llm import html_extract

SAID = (
    "The harbour office opened at six, an hour before the first ferry. A clerk in a grey coat unlocked the shutters and set the tide tables out. "
    "By seven a line of drivers stood along the quay, most of them with coffee from the kiosk. Nobody hurried, because fog still hid the far shore."
).split()
OTHER = "Later that week the council met again and voted for a new pier, which pleased the fishermen more than the hotel owners on the hill.".split()


def words(n, of=SAID):
    return " ".join((of * 9)[:n])


@pytest.fixture(scope="module")
def text():
    m = html_extract.default_model()
    return lambda page: html_extract.main_text(page, m)


@pytest.mark.parametrize("n", [8, 10, 20, 40, 90])
def test_plain_layouts(text, n):
    a, b, c = words(n), words(n + 1, OTHER), words(n + 2)
    for page, want in (
        (f"<html><body><p>{a}</p></body></html>", [a]),
        (f"<p>{a}", [a]),
        (f"<div class='x'><p>{a}</p></div>", [a]),
        (f"<html><body><p>{a}</p><p>{b}</p><p>{c}</p></body></html>", [a, b, c]),
        (f"<body><div><div><p>{a}</p><p>{b}</p></div></div></body>", [a, b]),
        (f"<html><head><title>No text</title></head><body><div class='qzk'><section><p>{a}</p></section></div></body></html>", [a]),
        (f"<html><body><h1>An evening at sea</h1><p>{a}</p></body></html>", ["An evening at sea", a]),
        (a, [a]),
        (f"{a}\n\n  {b}", [f"{a} {b}"]),
    ):
        assert text(page) == "\n\n".join(want), page


def test_plain_text_beside_other_things(text):
    a, b = words(45), words(30, OTHER)
    page = "<html><body><nav><a href=1>Home</a> <a href=2>News</a></nav>{}<footer>Copyright 2020 the owners</footer></body></html>"
    assert text(page.format(f"<p>{a}</p><p>{b}</p>")) == f"{a}\n\n{b}"
    page = "<html><body><ul class='menu'><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul>{}<div class='comments'><p>I like it</p></div></body></html>"
    assert text(page.format(f"<div><p>{a}</p><p>{b}</p></div>")) == f"{a}\n\n{b}"
    page = "<body><article><p>{}</p><div class='ad'><p>Buy two and get one of them free today</p></div><p>{}</p></article><aside><p>Read more of these</p></aside></body>"
    assert text(page.format(a, b)) == f"{a}\n\n{b}"


@pytest.mark.parametrize(
    ("inside", "want"),
    [
        ("Before <svg><title>t</title><text>no</text></svg> after.", "Before after."),
        ("Before <script>var a = '<p>';</script> after.", "Before after."),
        ("Before <style>p {}</style>after.", "Before after."),
        ("Before <picture><source srcset=a><img src=b></picture> after.", "Before after."),
        ("Before <noscript><img src=x></noscript>after.", "Before after."),
        ("We have <math><mi>x</mi><mo>=</mo><msup><mn>2</mn><mi>n</mi></msup></math> here.", "We have x=2n here."),
        ("A <math><semantics><mi>y</mi><annotation>\\y</annotation></semantics></math> alone.", "A y alone."),
        ("Before <my-tag class=x>inside</my-tag> after.", "Before inside after."),
        ("un<img src=x>seen", "unseen"),
        ("un<b>bro</b>ken and <i>so</i>", "unbroken and so"),
        ("one<br>two", "one two"),
        ("one<br/>\n two", "one two"),
        ("a<wbr>b &amp; c&nbsp;d &#x4e2d; &#0;", "ab & c d 中 �"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("Before <!-- <p>no</p> --> after", "Before after"),
        ("Before <template><p>no</p></template>after", "Before after"),
    ],
)
def test_a_block_stays_one(text, inside, want):
    a, b = words(40), words(35, OTHER)
    want = " ".join(want.split())
    assert text(f"<html><body><article><p>{a}</p><p>{inside}</p><p>{b}</p></article></body></html>") == f"{a}\n\n{want}\n\n{b}"


def test_blocks_are_parted(text):
    a, b = words(40), words(35, OTHER)
    assert text(f"<article><p>{a}<hr>{b}</article>") == f"{a}\n\n{b}"
    assert text(f"<article><div>{a}<p>{b}</p></div></article>") == f"{a}\n\n{b}"
    assert text(f"<article><ul><li>{a}<li>{b}</ul></article>") == f"{a}\n\n{b}"


def test_nothing_to_find(text):
    assert text("") == text(None) == text("<html><body></body></html>") == text("  \n ") == text("<script>x</script>") == ""
