"""Pages whose main text is marked, for learning the weights of the extraction (operator 3).

``LAYOUTS`` are written by hand in many styles of markup; elements with ``data-main`` hold main text and
those with ``data-rest`` none, whatever holds them.  ``W3`` stands for three filler words and so on.
"""

from __future__ import annotations

import re

LAYOUTS = (
    '<html><head><title>W4</title></head><body><header class="site-header"><a href="/">W2</a><p class="tagline">W4</p></header><nav class="menu"><ul><li><a href="#">W1</a></li><li><a href="#">W2</a></li><li><a href="#">W1</a></li></ul></nav><div class="ad">W9</div><article data-main><h1>W6</h1><p>W40</p><p>W25 <b>W3</b> W12</p><p>W1</p></article><footer>W8</footer></body></html>',
    '<body><div id="header"><h2><a href="/">W2</a></h2></div><div id="nav"><a href="#">W1</a> <a href="#">W1</a></div><div id="content" class="post-content" data-main><h1 class="title">W7</h1><p>W30</p><blockquote><p>W18</p></blockquote><ul><li>W9</li><li>W7</li></ul><p>W22 <a href="#">W2</a> W9</p></div><div id="sidebar"><h3>W2</h3><ul><li><a href="#">W4</a></li></ul><p>W9</p></div><div id="footer">W6 <a href="#">W1</a></div></body>',
    '<body><header role="banner"><p>W5</p></header><main data-main><article><header><h1>W5</h1><p class="byline">W3</p></header><section><h2>W3</h2><p>W35</p></section><section><h2>W4</h2><p>W28</p><table><tr><td>W3</td><td>W2</td></tr></table></section></article></main><aside class="related"><h2>W2</h2><ul><li><a href="#">W5</a></li></ul><p>W7</p></aside><footer class="site-footer"><p>W9</p></footer></body>',
    '<body><div class="cookie-notice banner" role="alert"><p>W12</p><button>W1</button></div><div class="wrapper"><div class="article-body" data-main><p>W33</p><div class="advert ads" data-rest><p>W10</p></div><p>W29</p><aside class="promo newsletter" data-rest><form><label>W3</label><input name="e"><button>W1</button></form><p>W8</p></aside><p>W31</p></div><section class="comments" id="comments"><h3>W1</h3><div class="comment"><p>W14</p></div><div class="comment"><p>W20</p></div></section></div></body>',
    '<body><ul class="breadcrumb breadcrumbs"><li><a href="#">W1</a></li><li>W2</li></ul><article class="entry" data-main><h1>W6</h1><p>W24</p><figure><img src="x"><figcaption>W6</figcaption></figure><p>W44</p><div class="share social" data-rest><a href="#">W1</a><a href="#">W1</a><span>W2</span></div><section class="comments" data-rest><h2>W2</h2><ol><li class="comment"><p>W16</p></li><li class="comment reply"><p>W11</p></li></ol><form><p>W4</p></form></section></article><div class="popup modal subscribe"><p>W10</p></div></body>',
    '<body><form class="search" action="/s"><p>W2</p></form><div class="notice alert"><p>W11</p></div><div class="main content" data-main><h1>W4</h1><p>W19</p><p>W2</p><pre>W12</pre><p>W26</p></div><div class="sponsored sponsor"><p>W12</p></div><div class="side sidebar widget"><p>W13</p></div><div class="legal disclaimer copyright"><p>W15</p></div></body>',
    '<body><nav><p>W4</p></nav><article data-main><p>W3</p></article><footer><p>W14</p><nav><a href="#">W2</a></nav></footer></body>',
    '<body><header><h1>W2</h1><p>W6</p></header><div class="text story" data-main><p>W21</p><p>W33</p></div><div class="tags meta related-posts"><a href="#">W1</a> W4</div><div class="discussion responses"><p>W18</p></div><div class="pagination pager"><a href="#">W1</a></div></body>',
    '<body><h1 data-main>W5</h1><p data-main>W24</p><p data-main>W41</p><p data-main>W17</p></body>',
    '<body><div class="top topbar login"><p>W5</p></div><section data-main><h2>W4</h2><p>W28</p><p>W35</p></section><aside><p>W22</p></aside><div class="disqus thread"><p>W12</p></div><div class="gdpr consent privacy"><p>W16</p></div></body>',
    '<body class="has-sidebar"><header class="page-header" role="banner"><p>W6</p></header><div role="navigation" class="navigation navbar"><a href="#">W2</a><a href="#">W3</a></div><article class="post" data-main><header class="entry-header"><h1>W6</h1><p class="byline meta">W4</p></header><p><a href="#">W5</a></p><h2><a href="#">W4</a></h2><ul><li><a href="#">W6</a></li><li><a href="#">W5</a></li><li><a href="#">W7</a></li></ul><p>W44</p><div class="ad ads advert advertisement" data-rest><p>W9</p></div><p>W31 <a href="#">W3</a> W18</p><div class="sponsor sponsored promo promotion" data-rest><p>W9</p></div><section class="legal"><p>W22</p></section><div class="newsletter subscribe subscription signup" data-rest><p>W9</p></div><p>W27</p><footer data-rest><p>W7</p></footer></article><div role="contentinfo" class="colophon"><p>W9</p></div></body>',
    '<body><main data-main><div class="content body entry"><h1>W5</h1><p>W37</p><nav class="toc" data-rest><a href="#">W3</a></nav><div class="related recommended" data-rest><a href="#">W6</a><p>W8</p></div><p>W33</p><div class="share sharing social social-links" data-rest><a href="#">W2</a></div><div class="breadcrumb" data-rest><a href="#">W3</a></div><div class="pagination pager paging" data-rest><a href="#">W2</a></div><p>W26</p><div class="sidebar widget" data-rest><p>W9</p></div><div class="menu nav navigation" data-rest><a href="#">W3</a></div><aside data-rest><p>W8</p></aside></div><div role="complementary" data-rest><p>W9</p></div></main></body>',
    '<body><div role="dialog" class="overlay modal"><p>W9</p></div><div class="search-form" role="search"><p>W3</p></div><article data-main><h1>W5</h1><p>W36</p><p>W29</p><div class="cookie cookie-notice consent gdpr" data-rest><p>W9</p></div><div class="popup modal" role="dialog" data-rest><p>W9</p></div><div class="notice alert" role="alert" data-rest><p>W9</p></div><div class="comment comments comment-list" id="comments" data-rest><h3>W2</h3><p>W12</p></div><div class="discussion respond responses reply replies disqus thread" data-rest><p>W14</p></div><div role="navigation" data-rest><p>W5</p></div><div role="contentinfo" class="site-footer" data-rest><p>W6</p></div></article></body>',
    '<body><div class="topnav menu-bar"><a href="#">W2</a></div><div class="ads advertisement banner-ad"><p>W8</p></div><div class="story article content" data-main><h1>W5</h1><p>W38</p><p>W30</p></div><div class="recommended"><p>W12</p></div><div class="share sharing"><a href="#">W2</a></div><div class="replies respond reply"><p>W16</p></div><div class="signup subscription promotion"><p>W9</p></div><div class="footer" role="contentinfo"><p>W9</p></div></body>',
)


def pages() -> list[str]:
    fill = lambda m: " ".join(["word"] * int(m[1]))
    return [re.sub(r"\bW(\d+)\b", fill, x) for x in LAYOUTS]
