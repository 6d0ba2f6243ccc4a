"""Labelled pages for the weights of the main-text extractor: fragments of common page layouts with their label.

Each page is a list of ``(fragment, is main text)`` in page order; fragments may open an element that a later one closes.
"""

from __future__ import annotations

Page = list[tuple[str, bool]]

#: Page furniture as it stands on common sites.
_FURNITURE = [
    "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/c'>Contact</a></li></ul></nav>",
    "<div id='menu'><a href='/a'>Start</a> <a href='/b'>Shop</a> <a href='/c'>About us</a></div>",
    "<ul class='navbar main-nav navigation'><li><a href='/1'>World</a></li><li><a href='/2'>Local</a></li></ul>",
    "<header class='site-header masthead'><h1>Daily Paper</h1><p>All the news of the valley since long ago</p></header>",
    "<div id='header'><a href='/'>Valley News</a><span>Thursday edition</span></div>",
    "<div class='top banner'><p>Big sale on garden tools this week only</p></div>",
    "<div class='cookie-notice'>We use cookies to improve your stay on our pages.</div>",
    "<div id='gdpr-consent' role='alert'><p>Your privacy matters to us and our partners.</p><button>Accept</button></div>",
    "<div class='alert notice'><p>This site will be closed on Sunday for maintenance.</p></div>",
    "<aside class='sidebar'><h3>Most read</h3><ul><li><a href='/s1'>One story</a></li><li><a href='/s2'>Another</a></li></ul></aside>",
    "<div id='sidebar' class='widget'><h4>Archive</h4><ul><li><a href='/m'>May</a></li></ul></div>",
    "<aside><p>See also our guide to the river and its fish.</p></aside>",
    "<div role='complementary'><p>From our partners in the region</p></div>",
    "<div class='ad'>Buy now and save a lot of money today.</div>",
    "<div class='ads advert'><p>The best boots for every road, now in our shop.</p></div>",
    "<section class='advertisement sponsored'><p>Sponsored: a holiday you will not forget.</p></section>",
    "<div id='adv' class='adverts sponsor promo'><a href='/x'>Win a new car</a></div>",
    "<div class='promotion'><h3>Subscribe and save</h3><p>Three months for the price of one.</p></div>",
    "<div class='share social'><a href='x'>Share</a><a href='y'>Print</a><a href='z'>Mail</a></div>",
    "<ul class='sharing social-links'><li><a href='x'>Follow us</a></li></ul>",
    "<div class='related'><h3>Related</h3><ul><li><a href='/r1'>Floods last year</a></li></ul></div>",
    "<section id='related-stories'><h2>More like this</h2><p>Council seeks money for a new bridge</p></section>",
    "<div class='newsletter'><h3>Our letter</h3><form><label>Your mail</label><input></form></div>",
    "<form action='/subscribe'><label>Your name</label><input><p>We never pass on your address.</p></form>",
    "<form class='search'><input><button>Search</button></form>",
    "<div id='login' class='popup modal overlay'><p>Please sign in to go on reading</p></div>",
    "<dialog><p>Do you want to install our app?</p></dialog>",
    "<button>Show all of it</button>",
    "<menu><li>Cut</li><li>Copy</li></menu>",
    "<select><option>German</option><option>French</option></select>",
    "<div class='breadcrumb breadcrumbs'><a href='/'>Home</a> <a href='/g'>Garden</a></div>",
    "<div class='pagination'><a href='?1'>1</a><a href='?2'>2</a></div>",
    "<div class='toolbar'><button>Larger text</button><button>Smaller text</button></div>",
    "<div class='toc'><a href='#1'>First part</a><a href='#2'>Second part</a></div>",
    "<div class='comments'><p>Great advice, thank you!</p><p>Mine died.</p></div>",
    "<section id='comments'><h2>Comments</h2><article class='comment'><p>I was there and saw it all.</p></article></section>",
    "<ol class='comment-list replies'><li><p>Not true at all, ask my neighbour.</p></li></ol>",
    "<article class='comment reply'><p>Well said, and high time too.</p></article>",
    "<nav class='pages links'><a href='?1'>1</a><a href='?2'>2</a></nav>",
    "<form class='contact'><p>Write to us</p><textarea></textarea></form>",
    "<footer class='meta'><p>Printed on Thursday</p></footer>",
    "<aside class='info box'><p>The valley in numbers</p></aside>",
    "<div id='disqus_thread' class='comments-area'><p>Join the talk about this story</p></div>",
    "<footer>Copyright the paper, all rights reserved</footer>",
    "<footer class='site-footer'><ul><li><a href='/i'>Imprint</a></li></ul><p>Town hall, Main street</p></footer>",
    "<div id='footer' role='contentinfo'><p>Made with care in the valley.</p></div>",
    "<p hidden>Not to be seen by readers at all</p>",
    "<div aria-hidden='true'><p>Loading the rest of the page</p></div>",
]
#: Elements that hold main text, and main text for them.
_HOLDERS = [
    ("<article>", "</article>"), ("<main>", "</main>"), ("<article class='post'>", "</article>"), ("<div class='post'>", "</div>"), ("<div id='content'>", "</div>"),
    ("<main role='main'><article>", "</article></main>"), ("<div class='entry-content'>", "</div>"), ("<section class='article-body'>", "</section>"),
    ("<div class='story text'>", "</div>"), ("<table><tr><td>", "</td></tr></table>"), ("<div>", "</div>"), ("<article class='entry'><div class='body'>", "</div></article>"),
]
_MAIN = [
    "<h1>Rain returns</h1><p>The first rain in three months fell on the hills this morning, and farmers went out to see it.</p><p>More is expected.</p>",
    "<p>The river has <a href='/r'>risen a little</a> since then, <b>but not much</b>, and the old mill turns again.</p><p>Nobody was hurt.</p>",
    "<h2>How to prune a pear tree</h2><p>Wait for a dry day in late winter, when the buds are still closed.</p><ul><li>Cut dead wood first.</li><li>Then thin the crown.</li></ul>",
    "<header><h1>Minutes</h1></header><p>The council met on Tuesday evening and opened with the budget for the coming year.</p><blockquote>No new debt was taken on.</blockquote>",
    "<p>Two members were absent.<br>The meeting closed at nine, after a long talk about the bridge.</p><figure><figcaption>The old bridge</figcaption></figure>",
    "<h3>What we found</h3><table><tr><th>Year</th><td>Rain</td></tr><tr><th>Past</th><td>Little</td></tr></table><p>The numbers speak for themselves, say those who took them.</p>",
    "<div><h4>A note</h4><p>Take <span>two</span> buckets, <em>not one</em>, and see <a href='/w'>the list of wells</a>.</p><ol><li>Fill both.</li><li>Carry them home.</li></ol></div>",
    "<div class='image'><p><small>Seen from the north</small></p></div><dl><dt>Weir</dt><dd>A low dam across a river</dd></dl><h5>Later</h5><p><i>It held</i> for <strong>forty years</strong>.</p>",
    "<p class='lead intro'>Three days after the flood the town counts its losses.</p><ul class='list'><li class='item'>The mill</li></ul><ol class='steps list'><li>Dry the floor</li></ol>",
    "<header class='entry-header'><h2 class='title headline' id='top'>After the flood</h2></header><div class='image gallery links'><p>Before and after</p></div><table class='data'><tr><td class='value'>7</td></tr></table>",
    "<section class='part' id='area'><p class='text'>The lower meadow lies under a foot of sand, says <span class='name'>the miller</span>.</p><blockquote class='quote'>We start again.</blockquote><div class='wrapper container'><p>And so they do.</p></div></section>",
    "<div><div><ul><li><p>One for the road, and <span>one for</span> the pot.</p></li></ul></div></div><h6>End</h6><details><summary>How it was made</summary><p>By hand.</p></details>",
    "<section><h2>Second part</h2><p>Finally, seal larger cuts and clear the ground below the tree of all leaves.</p></section><pre>keep it dry</pre>",
]


def labelled_pages() -> list[Page]:
    """One page a holder and rotation: furniture before, main text with furniture in it, furniture after."""
    pages, n = [], len(_FURNITURE)
    for k, (begin, end) in enumerate(_HOLDERS * 4):
        at = 11 * k
        pick = lambda i, at=at: (_FURNITURE[(at + 5 * i) % n], False)
        body = [(begin + _MAIN[k % len(_MAIN)], True), pick(0), (_MAIN[(k + 1) % len(_MAIN)], True), pick(1), (_MAIN[(k + 3) % len(_MAIN)], True), (_MAIN[(k + 7) % len(_MAIN)] + end, True)]
        pages.append([("<html><body>", False), pick(2), pick(3), pick(4), *body, pick(5), pick(6), pick(7), ("</body></html>", False)])
    return pages
