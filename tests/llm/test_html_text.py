"""Two-pass block rules: pages of many shapes, a plain restatement of both passes, linear time."""

import random
import time

import pytest

from tidewake.llm.html_text import Block, blocks_of, first_pass, judged_blocks, main_text, second_pass

ENGLISH = "This is the story of a man who went to the sea and who did not come back to his house for many years, and it was told by all of them in the town. "
POLISH = (
    "W tym roku szkoła otworzyła nowe laboratorium, w którym uczniowie mogą prowadzić doświadczenia chemiczne pod opieką nauczycieli. "
    "Wyposażenie kupiono dzięki dotacji gminy oraz wpłatom rodziców, którzy od dawna prosili dyrekcję o taką pracownię. ")
CHINESE = "今年学校新建了一间实验室，学生们可以在老师的指导下进行化学实验。设备由市政府资助购买，家长们也捐了款，他们早就希望学校能有这样一间教室。实验室每天下午开放，周末也可以预约使用。许多学生表示，他们现在对自然科学更感兴趣了，老师们也非常高兴。"


def test_page_inside_a_form():
    prose = (ENGLISH * 2).strip()
    for opening, closing in (("", ""), ("<article>", "</article>")):
        page = f"<body><form id='aspnetForm'><nav><a href=/>Home</a></nav>{opening}<p>{prose}</p><p>{prose}</p>{closing}<form>Name <input></form></form>"
        assert main_text(page) == f"{prose}\n{prose}"
    # a small form is no text, wherever it stands
    assert main_text(f"<article><p>{prose}</p><form><p>{ENGLISH}</p></form></article>") == prose


@pytest.mark.parametrize("text", [POLISH, CHINESE])
def test_languages_without_stop_words(text):
    text = text.strip()
    page = f"<body><nav><a href=a>A</a></nav><div><h1>T</h1><p>{text}</p><p>x y</p><p>{text}</p></div><ul><li><a href=b>B</a></ul><footer>{text}</footer>"
    assert main_text(page) == f"{text}\nx y\n{text}"


def test_header_of_an_article():
    page = "<body><header><h1>Site</h1></header><article><header class='entry-header'><h1>My title</h1><p>By me</p></header><p>Some text.</p></article>"
    assert main_text(page) == "My title\nBy me\nSome text."


def test_bodies_named_as_such():
    prose = (ENGLISH * 2).strip()
    page = f"<body><div class='entry-content'><h2>About</h2><p>{prose}</p><p>So.</p></div><div><p>{prose}</p></div>"
    assert main_text(page).startswith(f"About\n{prose}\nSo.")
    assert blocks_of("<div role='main'><p>a</p></div>")[0].main and not blocks_of("<div class='main-menu'><p>a</p></div>")[0].main


def test_prose_beside_an_article():
    prose = (ENGLISH * 2).strip()
    assert main_text(f"<article><p>{prose}</p><p>{prose}</p></article><div><p>{prose}</p></div><p>Imprint</p>") == f"{prose}\n{prose}"
    # articles that hold little of the text decide nothing for the rest
    assert main_text(f"<article><p>Teaser</p></article><div><p>{prose}</p><p>{prose}</p></div>").endswith(f"{prose}\n{prose}")


def test_both_passes_decide_in_articles():
    link = "<p><a href=a>More about all of this</a></p>"
    page = f"<article><h1>Title</h1><p>{ENGLISH}</p><p>Short</p>{link}<p>|</p>{link}<p>{'lorem ipsum dolor ' * 8}</p></article>"
    assert [(t[:5], g, rule) for t, g, rule in judged_blocks(page)] == [
        ("Title", True, "neighbours"), ("This ", True, "stop words"), ("Short", True, "neighbours"), ("More ", False, "links"),
        ("|", False, "neighbours"), ("More ", False, "links"), ("lorem", True, "neighbours")]
    # a heading between links stays: it has a vote of its own
    assert main_text(f"<article>{link}<h1>Title</h1>{link}<p>{ENGLISH}</p></article>") == f"Title\n{ENGLISH.strip()}"


def test_time_grows_with_the_tags():
    shapes = [
        lambda n: "<div>" * n + "</span>" * n, lambda n: "<div>" * n + "</section>" * n, lambda n: "<b><div>" + "<i>" * n + "</b>" * n,
        lambda n: "<svg>" * n, lambda n: "<p>a" * n, lambda n: "<div><p>x" * n + "</p></b>" * n, lambda n: "<div class=ad>x" * n]
    for shape in shapes:
        page = shape(30_000)
        at = time.process_time()
        main_text(page)
        assert time.process_time() - at < 5


def test_stray_tags_close_nothing():
    assert main_text("<article><p>a</span>b</section></p></b><p>c</i> d</article>") == "ab\nc d"
    assert main_text("<article><div><b>a<div>b</b>c</div></div></article>") == "a\nbc"


def plain_second_pass(blocks, kinds, outside):
    """The rules of the second pass said once more, block by block."""
    good = []
    for i, (block, kind) in enumerate(zip(blocks, kinds)):
        if kind in ("good", "bad", "none"):
            good.append(kind == "good")
            continue
        others = [j for j in range(len(blocks)) if kinds[j] != "none" and (blocks[j].main or not block.main)]
        total = 1 if kind == "near" else 0
        for side in ([j for j in others if j < i][::-1], [j for j in others if j > i]):
            decided = next((n for n, j in enumerate(side) if kinds[j] in ("good", "bad")), None)
            between = [kinds[j] for j in (side if decided is None else side[:decided])]
            answer = None if decided is None else kinds[side[decided]]
            if answer == "good":
                total += 1
            elif kind == "short" and "near" in between:
                total += 0
            elif answer == "bad" or (kind == "short" and not block.main):
                total -= 1
        if block.main:
            good.append(total + 1 + block.heading >= 0)
        else:
            good.append(total - (2 if outside else 0) > 0)
    return good


def test_second_pass_against_its_plain_form():
    rng = random.Random(5)
    for _ in range(4000):
        n = rng.randrange(0, 12)
        blocks = [Block("x", 0, rng.random() < 0.5, False, rng.random() < 0.3) for _ in range(n)]
        kinds = [rng.choice(["good", "bad", "near", "short", "none"]) for _ in range(n)]
        outside = rng.random() < 0.5
        assert second_pass(blocks, kinds, outside) == plain_second_pass(blocks, kinds, outside), (blocks, kinds, outside)


@pytest.mark.parametrize("block, listed, outside, kind", [
    (Block(ENGLISH * 2, 0, False, False), True, False, "good"), (Block(ENGLISH, 0, False, False), True, False, "near"),
    (Block(ENGLISH * 2, 0, False, False), True, True, "near"), (Block(ENGLISH, 0, True, False), True, False, "good"),
    (Block(ENGLISH * 2, 0, True, True), True, False, "none"), (Block(ENGLISH, 100, False, False), True, False, "bad"),
    (Block(ENGLISH, 100, True, False), True, False, "good"), (Block("xx yy " * 30, 0, False, False), True, False, "bad"),
    (Block("xx yy " * 40, 0, False, False), False, False, "good"), (Block("xx yy " * 20, 0, False, False), False, False, "near"),
    (Block("xx yy " * 30, 0, True, False), True, False, "near"), (Block("xx yy " * 30, 0, True, False), False, False, "good"),
    (Block("short", 0, False, False), True, False, "short"), (Block("short", 1, False, False), True, False, "bad"),
    (Block("short", 1, True, False), True, False, "short"), (Block("今" * 36, 0, True, False), False, False, "good")])
def test_first_pass(block, listed, outside, kind):
    assert first_pass(block, listed, outside)[0] == kind
