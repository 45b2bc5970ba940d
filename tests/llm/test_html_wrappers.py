"""Raw elements, wrappers with suspect names, and pages whose names would leave nothing."""

import pytest

from helioframe.llm import html_extract

ART = "The roof holds forty modules. " * 8
NAV = '<nav><a href="/">Home</a> <a href="/b">About</a></nav>'
FOOT = '<footer>Terms of use</footer>'


def text(html):
    page = html_extract.blocks(html)
    return html_extract.text_in(page, html_extract.best_path(html_extract.container_scores(page))) or ""


@pytest.mark.parametrize("raw", [
    "<script src=/js/>var secret=1;</script>", '<script src="x.js"/>var secret=1;</script>', "<style media=print/>.secret{}</style>", "<iframe src=/a/>secret</iframe>",
    "<svg><g><svg><text>secret</text></svg><text>secret</text></g></svg>", "<svg viewBox='0 0 1 1'/>", "<template><template>secret</template>secret</template>",
    "<script>if (a < b) document.write('<script>secret<' + '/script>');</script>",
])
def test_raw_elements_leave_nothing(raw):
    assert text(f"<body>{NAV}<article><p>{ART}</p>{raw}<p>End of it.</p></article>{FOOT}</body>") == ART.strip() + "\n\nEnd of it."


@pytest.mark.parametrize("wrapper", ['<div class="site has-sidebar">', '<div id="page" class="no-sidebar">', '<div class="post legal-news">', '<section class="notice-of-meeting">', '<div class="site has-sidebar"><div class="main no-sidebar">', '<div class="notice">'])
def test_wrappers_with_suspect_names(wrapper):
    tag = wrapper[1:].split()[0]
    inner = f'<h1>Title</h1><p>{ART}</p><div class="sidebar">Side</div><div class="cookie-banner">Cookies!</div><ul class="comment-list"><li>First!</li></ul>'
    assert text(f"<body>{NAV}{wrapper}{inner}</{tag}>{FOOT}</body>") == "Title\n\n" + ART.strip()


def test_long_comments_stay_out():
    comments = "".join(f"<li>I disagree with all of this, number {i}.</li>" for i in range(40))
    assert text(f'<body>{NAV}<article><p>{ART}</p></article><div class="comments-section"><ul>{comments}</ul></div><div class="site-footer">Imprint</div></body>') == ART.strip()


def test_pages_without_text():
    assert text("") == "" and text(f"<body>{NAV}{FOOT}</body>") == "" and text("<script>x") == ""
