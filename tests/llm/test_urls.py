import itertools
import math
import re

from pyspark.sql import functions as F

from tessera.llm import urls
from tessera.llm.queries import URL_RULES

CASES = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM", "http://www.example.com/en/1", "http://Example.com/en/", "https://a.example.com/en/x?y=/", "ftp://x.net/es/a", "ftp://x.net/es", "http://net/fr/", "http://notcom/x", "a://b://c/d", "http://É.com/p", "http://x.org?q=://y", "http://x.com/\na#b", "http://cheap-pills.example.org/", "http://cheappills.org/x", "http://spamfarm.org/" + "a" * 20000]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def rule(host, path):
    found = []
    for verdict, text in URL_RULES:
        name, rest = text.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            found.append((len(text), text, verdict))
    return max(found)[1:] if found else (None, None)


def brute_score(counts, host, path):
    """Naive Bayes by its definition, on splits found by trying all of them where a name is short, else by the segmenter."""
    own = {**counts}
    floor = max(1, round(urls.HOST_SHARE * max(sum(counts.values()), 1 / urls.HOST_SHARE)))
    for w in urls.HOST_WORDS:
        own[w] = max(floor, own.get(w, 0))
    total = sum(own.values())
    segmenter = urls.Segmenter(counts)

    def cost(words):
        return sum(-math.log(own[w] / total) if w in own else math.log(total) + len(w) * math.log(10) for w in words)

    def split(name):
        if len(name) > 12:
            return list(segmenter.split(name))
        found = [[name[a:b] for a, b in itertools.pairwise((0, *cuts, len(name)))] for k in range(len(name)) for cuts in itertools.combinations(range(1, len(name)), k)]
        best = min(found, key=cost)
        assert abs(cost(best) - cost(segmenter.split(name))) < 1e-9
        return list(segmenter.split(name))

    def tokens(h, p):
        names = re.split(r"[^a-z]+", f"{h} {p.lower()}")
        return [w for n in names if len(n) > 2 and n not in urls.SILENT for w in split(n) if len(w) > 2]

    lists = [[w for u in some for w in tokens(*u.partition("/")[::2])] for some in (urls.BLOCKED, urls.ALLOWED)]
    seen = set(lists[0]) | set(lists[1])
    score = math.log((len(urls.BLOCKED) + 1) / (len(urls.ALLOWED) + 1))
    for w in tokens(host, path):
        if w in seen:
            score += math.log((lists[0].count(w) + 1) / (len(lists[0]) + len(seen))) - math.log((lists[1].count(w) + 1) / (len(lists[1]) + len(seen)))
    return score


def test_rules_against_brute_force(spark):
    pages = spark.createDataFrame([(i, c, "<p>the farm and the garden</p>") for i, c in enumerate(CASES)], "page_id long, url string, html string")
    pages = pages.unionByName(pages.where("page_id < 3")).unionByName(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html"))
    pages = pages.withColumn("host", F.lit(1)).withColumn("verdict", F.lit(1)).withColumn("k0", F.lit(2)).withColumn("score", F.lit(3))
    counts = urls.fit_unigrams(pages)
    got = urls.filter_urls(pages, URL_RULES, keep=("page_id", "url")).collect()
    assert len(got) == len(CASES) + 3 + 250
    for r in got:
        host, path = parts(r.url)
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name), r.url
        if len(r.url or "") < 200:
            score = brute_score(counts, host, path) if len(host) < 40 else r.score
            assert abs(r.score - score) < 1e-9, r.url
        assert r.verdict == (verdict or ("block" if r.score > 0 else "allow")), r.url
    assert {r.verdict for r in got} == {"allow", "block"}


def test_unigrams_against_brute_force(spark):
    texts = [None, "", "<p>The the&nbsp;CAT</p><script>var cat</script><style>dog{}</style> caf\u00e9 x ab" + "c" * 40, "<a href='thecat'>cat, cat.</a> éa the"]
    pages = spark.createDataFrame([(t,) for t in texts], "html string")
    assert urls.fit_unigrams(pages) == {"the": 3, "cat": 3}
    assert urls.fit_unigrams(pages, most=1) == {"cat": 3}
    assert urls.fit_unigrams(pages.limit(0)) == {}


COUNTS = {"the": 600, "of": 360, "and": 260, "a": 160, "sun": 4, "free": 8, "software": 6, "credit": 5, "union": 5, "open": 7, "source": 6, "cheap": 3, "city": 9, "lake": 3, "house": 9}


def test_segments_are_the_likeliest():
    s = urls.Segmenter(COUNTS)
    assert s.split("cheappills") == ("cheap", "pills") and s.split("opensourcesoftware") == ("open", "source", "software")
    assert s.split("creditunion") == ("credit", "union") and s.split("freesoftware") == ("free", "software")
    assert s.split("zzqx") == ("zzqx",)

    def cost(words):
        return sum(s.cost.get(w, math.log(s.total) + len(w) * math.log(10)) for w in words)

    def splits(x):
        return [[x]] + [[x[:k], *r] for k in range(1, len(x)) for r in splits(x[k:])] if x else [[]]

    for name in ("freebetx", "thesun", "spamlink", "aaab", "lakehouse"):
        assert abs(min(map(cost, splits(name))) - cost(s.split(name))) < 1e-9


# None of these is in the lists that the model is trained on.
BAD = """winbigcasino.org/jackpot pokernights.net/bet/bonus sexcams.net/live xxxvideos.org/free hotgirlsdating.net/meet buypills.net/cheap/meds viagraonline.org/buy
pharmacydiscount.net/pills/order seobacklinks.net/links/cheap trafficbot.info/clicks fakewatches.org/replica crackwarez.net/keygen torrentcrack.info/games
paydayloans.net/cash/instant lotteryjackpot.org/win bingobonus.net/cash nudecams.org/girls escortsex.net/adult spammail.org/bulk dietpillsonline.net/weight
gamehack.net/cheat/money replicabags.net/fake/sale slotsbonus.org/win casinobet.net/slots porntube.org/xxx adultsex.info/videos freecash.info/win/prize cheapmeds.info/drugs/buy""".split()
GOOD = """freesoftware.org/free/download creditunion.org/loans opensourceproject.net/docs citylibrary.org/books musicguide.net/learn weathernews.org/daily lakehouse.net/family/photos
travelblog.org/hotels/review gardenbooks.net/shop farmersmarket.org/farm/food sciencejournal.org/research/health schoolsport.net/girls/team carforum.org/auto/help
historyblog.net/post localnews.org/city/sport museumshop.org/store familykitchen.net/food/best codewiki.org/wiki/learn jobsboard.net/jobs photoclub.org/photo/guide
bankhelp.net/bank/credit movieguide.org/movies/review onlinelibrary.net/books/free mathschool.org/learn/video homeandgarden.net/house/guide chessworld.org/games
healthguide.org/weight/health communityforum.net/forum/help""".split()


def test_held_out_names():
    """Held-out precision and recall, stated in README."""
    model = urls.NaiveBayes(s := urls.Segmenter(COUNTS), urls.own_list(urls.BLOCKED), urls.own_list(urls.ALLOWED))
    assert not {u.split("/")[0] for u in BAD + GOOD} & {u.split("/")[0] for u in urls.BLOCKED + urls.ALLOWED}
    blocked = [u for u in BAD + GOOD if model.score(s.tokens(*u.partition("/")[::2])) > 0]
    hit = len(set(blocked) & set(BAD))
    print("held out:", hit, len(blocked), len(BAD), sorted(set(blocked) - set(BAD)), sorted(set(BAD) - set(blocked)))
    assert hit / len(blocked) >= 0.95 and hit / len(BAD) >= 0.9
    assert model.score(s.tokens("", "")) < 0 and model.score(s.tokens("tionsh.somewhere.org", "/de/1")) < 0


def test_rows_of_ones_own(spark):
    rows = spark.createDataFrame([("http://a.com/tulips/red", True), ("http://b.com/roses/red", False), ("http://c.com/roses", False), (None, True), ("http://d.com/x", None)], "url string, bad boolean")
    train = urls.labelled_rows(rows, "url", F.col("bad"))
    assert sorted(train[0]) == [("", ""), ("a.com", "/tulips/red")] and sorted(train[1]) == [("b.com", "/roses/red"), ("c.com", "/roses")]
    assert sum(map(len, urls.labelled_rows(rows, "url", F.col("bad"), most=2))) == 2
    got = urls.filter_urls(spark.createDataFrame([(1, "http://x.org/tulips"), (2, "http://x.org/roses")], "page_id long, url string"), [], html=None, train=train).collect()
    assert {r.page_id: r.score > urls.NaiveBayes(urls.Segmenter({}), [], []).base for r in got} == {1: True, 2: False}


def test_empty(nothing):
    assert urls.filter_urls(nothing, URL_RULES, url="text", html="text", keep=("doc_id",)).count() == 0
