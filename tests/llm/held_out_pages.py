"""Labelled pages that the extractor never learns from: ``{{`` and ``}}`` enclose main text, ``[[`` and ``]]`` what is none in it."""

PAGES = (
    # tables for layout, no class names
    """<html><body bgcolor="#fff"><table width="100%"><tr><td colspan="2"><font size="5">Valley Beekeepers</font> <a href="/">home</a> | <a href="/m">members</a> | <a href="/l">links</a></td></tr>
<tr><td width="120"><a href="1">Hives</a><br><a href="2">Honey</a><br><a href="3">Swarms</a></td><td>{{<h2>Wintering a weak colony</h2><p>A colony that enters October with fewer than five frames of bees seldom lives to see the willows bloom.
<p>Unite it with a stronger neighbour, through a sheet of newspaper, on the last warm evening you are given.<p>Feed both with thick syrup, and close the entrance to the width of a finger.}}</td></tr>
<tr><td colspan="2"><hr><font size="1">Copyright 2003 Valley Beekeepers. Best viewed at 800 by 600.</font></td></tr></table></body></html>""",
    # a blog of nested divisions
    """<html><head><title>On fermenting cabbage</title><style>p{}</style></head><body><div id="wrapper"><div id="header"><div id="logo"><a href="/">Crock and Salt</a></div><div id="navigation"><ul><li><a href="#">Recipes</a></li><li><a href="#">About</a></li></ul></div></div>
<div id="main"><div class="post"><div class="post-title">{{<h1>On fermenting cabbage</h1>}}</div><div class="post-meta">Posted by Ana on 3 May | 12 comments</div><div class="post-body entry">{{<p>Slice the heads as thin as you can bear, and weigh what you have before the salt goes in.</p><p>Two grams for every hundred is enough; more keeps it crisp &mdash; and slow.</p><p>Press until the brine stands over the leaves, then wait a month.</p>}}</div>
<div class="share-buttons"><a>Tweet</a> <a>Share</a> <a>Pin it</a></div></div><div id="comments" class="comments-area"><h3>12 comments</h3><div class="comment">I tried three grams and it was far too salty for the children.</div><div class="comment">Lovely, thank you for this one!</div></div></div>
<div id="sidebar" class="widget-area"><div class="widget"><h4>Archive</h4><ul><li><a>April</a></li><li><a>March</a></li></ul></div></div><div id="footer">Powered by a small computer under the stairs</div></div></body></html>""",
    # an encyclopedia entry
    """<!doctype html><html><body><div id="content" class="body" role="main"><h1 id="firstHeading">{{Basalt column}}</h1><div id="toc" class="toc" role="navigation"><ul><li><a href="#1">1 Formation</a></li><li><a href="#2">2 Places</a></li></ul></div>
<div id="bodyContent">{{<p>A <b>basalt column</b> is a prism of rock that forms when thick lava cools from its surfaces inwards.</p><h2>Formation</h2><p>Cooling rock shrinks, and cracks meet at angles that spend the least energy, so most columns have six sides.</p><h2>Places</h2><p>The best known stand at the coast of northern Ireland, where some forty thousand rise from the sea.</p>}}</div></div>
<div id="mw-navigation" class="navigation"><h2>Navigation menu</h2><ul><li><a>Log in</a></li><li><a>Random entry</a></li></ul></div><footer id="footer" role="contentinfo"><ul><li>This page was last edited on 2 June.</li><li><a>Privacy</a></li></ul></footer></body></html>""",
    # news with figures, a teaser rail and a notice
    """<html><body><div class="cookie-banner" role="dialog">We and our partners store data on your device. <button>Agree</button></div><nav aria-label="main"><a>World</a><a>Money</a><a>Weather</a></nav>
<main id="main-content"><article class="story"><header>{{<h1>Ferry returns after nine winters</h1>}}<div class="byline">By R. Holm, harbour desk</div></header><div class="story-body">{{<p>The first boat since the storm left the island at dawn with forty passengers and a dog.</p><figure><img src="a.jpg"><figcaption>The crew waits for the tide.</figcaption></figure><p>Islanders had sold boats, houses and one church organ to pay for the new pier.</p>}}<div class="advertisement">Advertisement: insure your roof today.</div>{{<p>Tickets cost what they did in 2014, said the harbour master, because nobody had changed the sign.</p>}}</div></article>
<aside class="related-rail"><h2>More on this story</h2><ul><li><a>Storm takes the pier</a></li><li><a>Who will pay?</a></li></ul></aside></main><footer class="site-footer">Contact the newsroom. Terms of use. All rights reserved.</footer></body></html>""",
    # documentation with code and a side menu
    """<html><body class="docs"><div class="topbar"><a>Docs</a><a>Download</a><input type="search"></div><div class="layout"><div class="sidebar menu"><ul><li><a>Install</a></li><li><a>Use</a></li><li><a>Upgrade</a></li></ul></div>
<div class="content" role="main"><section>{{<h1>Install the pump driver</h1><p>Unpack the archive next to the controller, and run the installer once as an administrator.</p><pre>pump install --port 3</pre><p>The lamp turns green when the driver answers.</p><ol><li>Open the valve by a quarter turn.</li><li>Wait until the pressure stands still.</li></ol>}}</section></div></div><div class="feedback-form form"><p>Was this page helpful?</p><button>Yes</button><button>No</button></div><div class="footer">Version 4, built in March</div></body></html>""",
)
