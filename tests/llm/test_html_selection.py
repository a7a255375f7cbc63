"""Main text of pages: omitted tags, deep nesting, link-rich paragraphs, and the selection against a plain recursion."""

import math
import random
import time

import pytest

from lanewise.llm.html_density import BLOCKS, LINK_LIST, LINK_SHARE, main_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<head><title>t</title><body><h1>Heading</h1><ul><li>first item<li>second item</ul>", "Heading\nfirst item\nsecond item"),
        ("<html><head><title>t</title><meta charset=utf-8><table><tr><td>a cell<td>another</table>", "a cell\nanother"),
        ("<head><link rel=x><h2>Heading</h2><p>One.<p>Two.", "Heading\nOne.\nTwo."),
        ("<head><title>t</title>Text of the body.", "Text of the body."),
        ("<head><style>p {}</style><script>x</script></head><p>Only this.", "Only this."),
        ("<title>t</title><p>No head at all.", "No head at all."),
    ],
)
def test_omitted_tags(page, text):
    assert main_text(page) == text


def test_link_rich_paragraphs_stay():
    rich = "See <a href=1>the first long reference</a>, <a href=2>the second long reference</a> and <a href=3>the third one</a>."
    page = f"<body><div><p>{'A sentence of the article. ' * 6}</p><p>{rich}</p><p>{'The end of the article. ' * 6}</p></div><ul><li><a href=4>one page</a><li><a href=5>other page</a><li><a href=6>last page</a></ul>"
    got = main_text(page).split("\n")
    assert len(got) == 3 and got[1] == "See the first long reference, the second long reference and the third one."


def test_depth_and_stray_ends_cost_linear_time():
    took = []
    for n in (25_000, 100_000):
        page = "<p>start" + "<div>" * n + "</b>" * n + "deep text" + "<li>" * n + "<i>" * n + "<td>" * n
        began = time.time()
        assert "deep text" in main_text(page)
        took.append(time.time() - began)
    assert took[1] < 12 * max(took[0], 0.2)


def random_page(rng):
    """A tree of (tag, children) with texts of words."""

    def element(depth):
        tag = rng.choice(("div", "section", "p", "span", "a", "ul", "div", "b"))
        if depth > 4 or tag in ("p", "a", "b"):
            return (tag, [" ".join(rng.choice(("lorem", "ipsum", "dolor")) for _ in range(rng.randrange(0, 30)))] + ([("a", ["a link to something"])] * rng.randrange(0, 3) if tag == "p" else []))
        return (tag, [element(depth + 1) if rng.random() < 0.75 else "bare words here " * rng.randrange(1, 5) for _ in range(rng.randrange(1, 5))])

    return ("body", [element(0) for _ in range(rng.randrange(1, 5))])


def markup(x):
    return x if isinstance(x, str) else f"<{x[0]}>{''.join(map(markup, x[1]))}</{x[0]}>"


def plain(body):
    """The selection, by recursive definitions on the tuples."""

    def size(x):
        """characters, tags, link characters, link tags, prose"""
        c = t = lc = lt = prose = 0
        for k in x[1]:
            if isinstance(k, str):
                c += len(k.strip())
            else:
                own = size(k)
                c, t, lc, lt, prose = c + own[0], t + own[1] + 1, lc + own[2], lt + own[3] + (k[0] == "a"), prose + own[4]
        if x[0] == "a":
            lc = c
        elif x[0] == "p":
            prose = c - lc
        return c, t, lc, lt, prose

    total = size(body)
    share = total[2] / max(total[0], 1)

    def density(c, t, lc, lt):
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        t, lc1, lt1 = max(t, 1), max(lc, 1), max(lt, 1)
        return c / t * math.log(max(c / lc1 * t / lt1, 1.0) + 1e-9) / max(math.log(base), 0.1) if base > 1 else c / t

    of = lambda x: density(*size(x)[:4])
    paths = []

    def walk(x, up):
        paths.append([x, *up])
        for k in x[1]:
            if not isinstance(k, str):
                walk(k, [x, *up])

    walk(body, [])

    def total_of(x):
        own = sum(len(k.strip()) for k in x[1] if isinstance(k, str))
        return sum(of(k) for k in x[1] if not isinstance(k, str)) + (density(own, 1, own if x[0] == "a" else 0, 0) if own else 0)

    path = max((p for p in paths if p[0][0] != "a"), key=lambda p: total_of(p[0]))
    least = min(of(x) for x in path)
    fits = [x for x in reversed(path) if size(x)[2] <= LINK_SHARE * size(x)[0]]
    container = fits[0] if fits else path[0]
    on_path = {id(x) for x in path}

    def is_list(x):
        c, _, lc, lt, prose = size(x)
        return x[0] in BLOCKS and lt >= LINK_LIST and lc > LINK_SHARE * c and not prose

    def texts(x):
        if isinstance(x, str):
            yield x
            return
        mark = "\0" if x[0] in BLOCKS else ""
        yield mark
        for k in x[1]:
            if isinstance(k, str) or id(k) in on_path or not is_list(k):
                yield from texts(k)
        yield mark

    def pick(x):
        if isinstance(x, str):
            if len(x.strip()) >= least > 0:
                yield "\0" + x + "\0"
        elif x is container:
            yield "\0" + "".join(texts(x)) + "\0"
        elif id(x) in on_path:
            for k in x[1]:
                if isinstance(k, str) or id(k) in on_path or not is_list(k):
                    yield from pick(k)
        elif of(x) >= least > 0 and size(x)[2] <= LINK_SHARE * size(x)[0]:
            yield "\0" + "".join(texts(x)) + "\0"

    return "\n".join(t for part in "".join(pick(body)).split("\0") if (t := " ".join(part.split())))


@pytest.mark.parametrize("seed", range(150))
def test_selection_matches_a_plain_recursion(seed):
    body = random_page(random.Random(seed))
    assert main_text(f"<html>{markup(body)}</html>") == plain(body)
