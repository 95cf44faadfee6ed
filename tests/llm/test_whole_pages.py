"""op9: depth never changes which element a block belongs to."""

import pytest

from tessera.llm import page_text


@pytest.mark.parametrize("depth", [10, 300, 5000])
def test_deep_pages(depth):
    page = "<article class='story'><p>First.</p>" + "<div>" * depth + "<nav><ul><li>Menu</ul></nav><p>Deep.</p>" + "</div>" * depth + "<p>Last.</p></article><footer>Foot</footer>"
    root = page_text.Place("-", (), None)
    found = {text: place for text, _, place in page_text.blocks(page, root)}

    def path(place):
        out = []
        while place.parent is not None:
            out.append(place.tag)
            place = place.parent
        return out[::-1]

    assert path(found["Menu"])[-3:] == ["nav", "ul", "li"] and path(found["Deep."]) == ["article", *["div"] * depth, "p"]
    assert path(found["First."]) == path(found["Last."]) == ["article", "p"] and path(found["Foot"]) == ["footer"]
    assert sorted(set(found["Menu"].described())) == sorted(found["Menu"].described()) and {"has=article", "has=nav", "near=nav", "name=story"} <= set(found["Menu"].described())
    field = page_text.Field({name: i for i, name in enumerate(found["Menu"].described()[1:])})
    field.w = page_text.np.random.default_rng(0).normal(size=field.w.shape)
    assert page_text.np.allclose(found["Menu"].weighed(field), field.w.sum(0))


def test_deep_unclosed(spark):
    plain = "<main><article><p>One sentence of the story.</p>{}<p>Another sentence of the story.</p></article></main><footer>&copy; me</footer>"
    rows = [(1, "u", plain.format("<div>" * 400 + "<nav><a href='/'>Home</a></nav>" + "</div>" * 400)), (2, "u", plain.format("<nav><a href='/'>Home</a></nav>"))]
    got = {r.page_id: r.text for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == "One sentence of the story. Another sentence of the story."


def of(page):
    return page_text.main_text(page, page_text.trained(), page_text.Place("-", (), None))


def test_layouts():
    assert of("<article><p title=it's>First one here.</p><p>Second doesn't stop.</p><p>Third it is.</p></article>") == "First one here. Second doesn't stop. Third it is."
    assert of("Only some words that stand alone. No tag is near them.") == "Only some words that stand alone. No tag is near them."
    text = "This is a sentence of some length about the topic, and another clause follows it."
    assert of(f"<html><head><title>Topic - Wiki</title></head><body><div id='mw-navigation'><ul><li><a href='/'>Main page</a></li><li><a href='/c'>Contents</a></li></ul></div><div id=content class='mw-body'><h1 id=firstHeading>Topic</h1>"
              f"<div id=bodyContent><div id=siteSub>From the free encyclopedia</div><div id='mw-content-text'><div class='mw-parser-output'><p>{text}</p><h2>History</h2><p>{text}</p></div></div></div></div><div id=footer>Terms of use</div></body></html>") == f"Topic {text} History {text}"
    assert of(f"<body><table><tr><td><a href=/a>Home</a><br><a href=/b>News</a></td><td><h1>Head</h1><p>{text}</p><p>{text}</p></td></tr></table></body>") == f"Head {text} {text}"
    assert of(f"<article><header><h1>Headline of it</h1><p class=byline>By me</p></header><p>{text}</p></article><div id=secondary><ul><li><a href=/>More</a></li></ul></div>") == f"Headline of it {text}"


def test_broken_tags_take_linear_time():
    import time

    for piece in ("<p ", "<p a='", '<p a="b', "<!-- ", "</", "<p =", "<title>", "<script>", "<div><"):
        began = time.time()
        of("<p>Some text.</p>" + piece * (1_000_000 // len(piece)))
        assert time.time() - began < 15, piece


def test_viterbi_and_gradient():
    import itertools

    np = page_text.np
    rng = np.random.default_rng(1)
    field = page_text.Field({f"f{i}": i for i in range(6)})
    field.w, field.start, field.step = rng.normal(size=(6, 2)), rng.normal(size=2), rng.normal(size=(2, 2))
    pages = [([rng.integers(0, 6, 3) for _ in range(n)], rng.integers(0, 2, n).tolist()) for n in (1, 4, 7)]

    def score(x, y):
        return field.start[y[0]] + sum(field.w[ids, k].sum() for ids, k in zip(x, y)) + sum(field.step[a, b] for a, b in zip(y, y[1:]))

    for x, _ in pages:
        e = np.array([field.w[ids].sum(0) for ids in x])
        assert field.viterbi(e) == list(max(itertools.product((0, 1), repeat=len(x)), key=lambda y: score(x, y)))
    value, grads = field.gradient(field.batch(pages))
    want = np.mean([score(x, y) - np.log(sum(np.exp(score(x, z)) for z in itertools.product((0, 1), repeat=len(x)))) for x, y in pages])
    assert abs(value - want) < 1e-9
    for param, g in zip((field.w, field.start, field.step), grads):
        for at in np.ndindex(param.shape):
            param[at] += 1e-5
            up = field.gradient(field.batch(pages))[0]
            param[at] -= 2e-5
            down = field.gradient(field.batch(pages))[0]
            param[at] += 1e-5
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6


S = "This is a sentence of some length about the topic, and another clause follows it."


@pytest.mark.parametrize("page, text", [
    (f"<div>{S}</div>", S), (f"<p>{S}", S), (f"<div class=qqq><div class=rrr>{S}</div><div class=zzz>{S}</div></div>", f"{S} {S}"),
    (f"<div class=thread><div class=message><div class=message-content>{S}</div></div></div>", S),
    (f"<section id=story><h2>Head line</h2><p>{S}</p><p>{S}</p></section>", f"Head line {S} {S}"),
    (f"<body><section id=story><h2>Head line</h2><p>{S}</p><p>{S}</p></section><div role=contentinfo>Terms of use</div></body>", f"Head line {S} {S}"),
    (f"<article><p>{S}</p><template><p>Not shown yet</p></template><noscript>Please enable JavaScript.</noscript><p>{S}</p></article>", f"{S} {S}"),
    ("<nav><a href=/>Home</a></nav>", ""), ("<footer>Terms of use</footer>", ""),
    (f"<article><p>{S}</p></article><div class=comments><div class=comment>{S}</div></div>", S),
])
def test_small_pages(page, text):
    assert of(page) == text


def test_own_names_keep_no_places(monkeypatch):
    """Pages with names of their own share the places of pages without; where known names make too many, the tree starts anew."""
    field = page_text.trained()
    root, plain = field.root(), field.root()
    for i in range(400):
        page = "".join(f"<div id='e{chr(97 + i % 26)}q{chr(97 + j)}{chr(97 + i // 26)}z' class='k{i}-{j} v{i}'><p id=n{i * j}>{S}</p></div>" for j in range(20))
        assert page_text.main_text(page, field, root) == page_text.main_text(f"<div class='qq'><p id=qq>{S}</p></div>" * 20, field, plain)
    assert root.shared.kept <= 20 and len(root.shared.names) <= page_text.SHARED_PLACES
    monkeypatch.setattr(page_text, "SHARED_PLACES", 30)
    names = sorted(root.shared.known)
    small, most = field.root(), 0
    for i in range(100):
        page = "".join(f"<div class='{names[(i + 7 * j) % len(names)]} {names[(i * j) % len(names)]}'><p>{S}</p></div>" for j in range(20))
        assert page_text.main_text(page, field, small) == page_text.main_text(page, field, field.root())
        most = max(most, small.shared.kept, len(small.shared.names))
    assert most <= 30
