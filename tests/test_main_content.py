"""Main content of literal pages, by scores handed up the element tree."""

from ragmill.operators import extract

P = "<p>This is a sentence with some words, and a comma, which goes on for a while to be long.</p>"
LINKS = "".join(f'<p><a href="/{i}">A link that is long enough to count as a paragraph, {i}</a></p>' for i in range(9))


def test_known_content(spark):
    pages = {
        1: f"<title>One</title><body><div class='menu'>{LINKS}</div><div id='x'><div>{P}{P}{P}</div></div><div><p>Short.</p></div></body>",
        2: f"<body><section>{P}{P}</section><section>{P}{P}</section><section><p>tiny</p></section></body>",
        3: "<body><div>no paragraphs here but text enough to be found as it is</div><div><a>a link</a></div></body>",
        4: "",
        5: f"<body><nav>{P * 9}</nav><table><tr><td>{'cell text, ' * 20}</td></tr></table></body>",
    }
    got = {r.page_id: r for r in extract.main_content(spark.createDataFrame(list(pages.items()), "page_id long, html string")).collect()}
    sentence = "This is a sentence with some words, and a comma, which goes on for a while to be long."
    assert got[1].title == "One" and got[1].text == " ".join([sentence] * 3) and got[1].score == 3 * 3 + 5
    assert got[2].text.count("This is") == 4
    assert got[3].text.startswith("no paragraphs") and got[4].text == "" and got[4].score == 0
    assert "cell text" in got[5].text and "This is" not in got[5].text


def test_scores_go_to_parent_and_grandparent(spark):
    html = f"<div><section>{P}</section><section>{P}</section></div>"
    rows = extract.blocks(spark.createDataFrame([(1, html)], "page_id long, html string"))
    got = {r.start: r.score for r in extract.handed_up(rows).collect()}
    assert got == {0: 5 + 3 / 2 + 3 / 2, 1: 3.0, 3: 3.0}
