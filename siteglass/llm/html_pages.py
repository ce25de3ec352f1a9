"""Pages labelled by hand, from which the weights of main-text extraction are learned.

``{{`` and ``}}`` enclose main text, ``[[`` and ``]]`` what is not main text although it lies inside.
"""

PAGES = (
    """<!DOCTYPE html><html><head><title>Tides</title><script>var a="<p>";</script></head><body>
<header class="site-header"><div class="logo">Harbour Daily</div><nav class="menu"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav></header>
<div class="cookie-notice" role="alert">We use cookies to improve this site. <button>Accept</button></div>
<main><article>{{<h1>How tides are measured</h1><p>A gauge at the pier has logged the <b>height</b> of the water every six minutes since 1911.</p>
<p>The record shows a slow rise, and the <a href="/g">gauge keepers</a> explain why it is not even.</p>[[<div class="ad">Buy two boats and save on the third.</div><aside class="sidebar"><h3>Related</h3><ul><li><a>Moon phases for the year</a></li></ul></aside>]]
<h2>Storms</h2><ul><li>Surges come with low pressure.</li><li>Wind piles the water up.</li></ul><blockquote>It is a simple machine, said the keeper.</blockquote>}}</article></main>
<section class="comments" id="comments"><h3>Reader comments</h3><div class="comment"><p>I remember the old gauge, it was green and it leaked.</p></div><form class="comment-form"><label>Your name</label><input><textarea></textarea></form></section>
<footer class="footer"><p>Copyright Harbour Daily. All rights reserved. Terms and privacy.</p></footer></body></html>""",
    """<html><body><div id="page"><div id="top" class="navbar nav"><a href="/a">Start</a> | <a href="/b">Archive</a> | <a href="/c">Contact us</a></div>
<div class="banner advert ads">Summer sale: every chair at half its price this week only.</div>
<div id="content" class="content post entry">{{<h1>Baking with rye</h1><p>Rye holds more water than wheat, so the dough stays sticky for longer than expected.</p><p>Use a wet hand and a tin.</p>
<table><tr><td>Flour</td><td>500 g</td></tr><tr><td>Water</td><td>420 g</td></tr></table><pre>bake 50 minutes at 200 degrees</pre>}}</div>
<div id="sidebar" class="widget"><h4>Popular</h4><ul><li><a href="/1">Ten breads to try</a></li><li><a href="/2">Why salt matters</a></li></ul><div class="promo sponsored">Flour by post, straight from the mill to the door.</div></div>
<div class="newsletter subscribe"><form action="/n"><p>Sign up for our letter and get one recipe every week.</p><input type="email"><button>Join</button></form></div>
<div class="related-posts"><p>You may also like: cold proofing, hot stones.</p></div><div id="footer" class="copyright">Printed on recycled bits since 2003 by the Crumb Society of the North.</div></div></body></html>""",
    """<html lang="de"><body><nav><ul><li><a href="/x">Seite</a></li><li><a href="/y">Karte</a></li></ul></nav><div class="ad">Jetzt neue Fenster kaufen und sparen.</div>
<article>{{<h1>Die Bahn im Tal</h1><p><b>Die Bahn im Tal fährt seit hundert Jahren.<br><p>Im Winter räumt ein Pflug die Strecke.</p><p>Kurz.</p><p>Wer mitfahren will, braucht eine Karte und etwas Geduld, denn die Wagen sind alt.</p>}}</article>
<footer>&copy; tal.example &middot; Alle Rechte vorbehalten, Angaben ohne Gewähr.</footer></body></html>""",
    """<html><body><div class="header"><h2>Garden notes</h2><p class="tagline">Short notes on long beds</p></div><div class="breadcrumb breadcrumbs">Home &gt; Soil &gt; Worms</div>
<div class="notice alert message">Our shop is closed on Monday for stock taking.</div>
<section class="article-body text story">{{<h1>Worms</h1><div><p>A handful of soil with five worms is a good sign.</p><p>Count them in spring, after rain.</p></div><figure><img><figcaption>A worm at work in the upper bed.</figcaption></figure><ol><li>Dig one spade deep.</li><li>Count and put them back.</li></ol>}}[[<div class="share social">Share this on your wall, by mail or by post</div><div class="author-bio bio">The writer grows beans and lives by the sea.</div>]]</section>
<aside><div class="poll"><form><p>Which bed do you dig first?</p><select><option>North</option><option>South</option></select></form></div></aside>
<div id="disqus_thread" class="comment-list responses"><article class="comment"><p>Five worms? I found fifty of them and a coin.</p></article><div class="reply"><p>Lucky you, mine all left in August.</p></div></div>
<div class="pagination pager"><a>Previous</a> <a>Next</a></div><footer><ul><li><a>About</a></li><li><a>Imprint</a></li></ul></footer></body></html>""",
    """<html><body><header><a href="/">Ledger</a><form role="search"><input><button>Search</button></form></header><ul class="menu"><li><a>Rates</a></li><li><a>Charts</a></li></ul>
<div class="wrapper container"><div class="main">{{<h1>Rates hold</h1><p>The bank left its rate where it was, as most had expected, and said little about autumn.</p><p>Bond prices moved by less than a tenth.</p><dl><dt>Rate</dt><dd>Two percent</dd></dl>}}</div>
<div class="right-column rail"><p>Most read today: six funds that lost nothing, and one that did.</p></div></div><div class="popup modal overlay consent gdpr">This site sets cookies. Choose what to allow.</div><div class="disclaimer legal">Nothing here is advice to buy or to sell.</div></body></html>""",
    """<html><body><header><p>All the news of the valley</p></header><nav class="navigation"><p>Start, maps, letters</p></nav><div class="notice"><p>The office is shut today.</p></div><div class="ads"><p>Ride cheaper with the ten trip card from the kiosk.</p></div>
<div class="article content">{{<h1>The bridge</h1><p>Workers closed the last gap at noon.</p>[[<div class="advertisement"><p>New tyres, fitted while you wait.</p></div><aside class="aside"><p>More on bridges and on those who build them.</p></aside>]]<p>Cars may cross from Friday.</p>}}</div>
<div class="sidebar"><p>Weather: rain, then more rain.</p><form><p>Search the old papers</p></form></div><div class="comments"><p>My father built the first one, with a rope and a mule.</p><p>It swayed when I was small.</p></div><footer><p>Printed in the valley.</p></footer></body></html>""",
    """<html><body><p class="skip-link">Skip to content</p><div>{{<h1>Plain page</h1><p>No class names here, only a few words in rows.</p><p>They still count as the text of the page, since nothing else does, and they go on for a while.</p>}}</div><hr><form><p>Leave your name and town</p><input></form><noscript>Please enable scripts</noscript></body></html>""",
    """<html><body><div class="alert alert-warning"><p>Trains to the coast run late today.</p></div><div class="cookie-banner consent"><p>We would like to store a few cookies with your browser.</p><button>Fine</button></div><div class="advert"><p>Boots that last ten winters.</p></div>
<article>{{<h1>Salt</h1><p>Salt was once <a href="/t">taxed by the pound</a> and carried by night.</p>[[<div class="notice notice-box"><p>This piece was changed on Tuesday.</p></div><div class="advert banner"><p>Half off all lamps.</p></div><div class="newsletter-signup"><p>Get the weekly letter.</p></div><div class="advert"><p>Two pans for one.</p></div><div class="ad"><p>Learn to sail by June.</p></div>]]<p>Today it costs <a href="/c">almost nothing</a>, and <a href="/w">wells</a> give more than anyone needs.</p>}}[[<section class="comments"><h2>Comments</h2><p>We still keep a sack in the cellar.</p></section>]]</article>
<section class="newsletter"><h2>Letters</h2><p>Leave your address and hear from us on Sundays.</p></section><ol class="comment-list"><li class="comment"><article class="comment-body"><p>My aunt was caught with two sacks under her coat.</p></article></li><li class="reply"><article class="comment-body"><p>So was mine.</p></article></li></ol><aside class="promo related"><p>Also by the same hand: pepper.</p></aside></body></html>""",
    """<html><body><div class="topbar header"><p>The Mill Weekly</p></div><div class="menu"><p>Front page, farms, fairs</p></div><div>{{<h1>Hedges</h1><p>A hedge is laid in winter, when <a href="/s">the sap</a> is down.</p><p>The stems are cut almost through and <a href="/b">bent</a> along the row; <em>they live on</em> and sprout.</p><ul><li>Use a <a href="/k">billhook</a>.</li><li>Leave the roots alone.</li></ul>}}</div>
<div class="message popup"><p>You have read three of five free pages.</p></div><div class="sponsored ads"><p>Gates in oak and in iron.</p></div><div class="discussion comments"><div class="comment"><b>Tom</b><p>Mine died, all forty yards of it.</p></div></div><div class="form subscribe"><p>Your mail address goes here.</p></div><div class="footer legal"><p>Mill Weekly, founded by the miller.</p></div></body></html>""",
)
