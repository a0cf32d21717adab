"""URL filters: rules first, then naive Bayes on words that a unigram Viterbi finds in host and path.

A rule is ``host/path``: it fits its host and all subdomains where the url's path starts with the
rule's; the longest that fits decides. The rest is scored: names such as ``cheapwatches`` are split into
the likeliest words, by counts of the words of all pages' texts, and a multinomial naive Bayes adds up
the words' log-odds. It is trained here on a short labelled list of invented urls; rows of one's own can
be given instead. Rules aren't taken as labels: they say where a page is, not what it is about.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed; an empty host is no subdomain of anything; very long urls are judged whole; a null page has no
words; repeated rows are judged alike; an empty table gives an empty result; other columns are never
read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most words that the model keeps, those with the highest counts, and rows that a classifier is trained on at most.
MOST_WORDS = 20_000
TRAIN_ROWS = 20_000

# Words of host names whose counts in running text say too little of how often they come there.
HOST_WORDS = """blog shop store online web site mail info wiki docs forum news home page app cloud data tech code dev game games video videos photo photos music
free best cheap buy sale deal deals offer bonus cash money loan loans credit casino poker slots bet betting bingo lottery jackpot porn sex xxx adult nude cam cams dating escort hot girls
pills pill pharmacy drugs meds diet weight spam seo link links clicks traffic replica fake crack warez torrent keygen hack cheat watches
university school college library science research health food travel sport sports weather history art museum city times post daily journal review community project open source software
learn guide book books garden kitchen family house car auto job jobs bank union world""".split()
#: A host word counts as if it made up this share of all words.
HOST_SHARE = 0.0002

# Invented urls that the naive Bayes is trained on, by what is to become of them.
BLOCKED = """bestmeds-online.net/cheap/pills/buy buy-viagra-now.org/pills discount-pharmacy.info/drugs/order dietpills4you.net/weight/loss/cheap
no-prescription-meds.net/buy luckycasino.net/slots/bonus grand-poker.org/bonus/win onlineslots777.net/jackpot/win betting-bonus.org/sport/bet/win
bingo-jackpot.info/cash lottery-winner.net/cash/prize roulette-casino.org/live/bet hot-cams-live.org/girls/nude freeporntube.net/videos/xxx
adult-videos.info/free/sex xxx-tube.org/porn nude-girls.net/photos escort-girls.org/city/hot sexdating.info/adult/meet adult-chat.net/cams
spam-mailer.net/bulk/mail/spam content-farm-articles.info/spam buy-backlinks.org/seo/links seo-traffic.info/clicks/cheap link-exchange.net/spam/links cheap-clicks.net/traffic/buy
auto-traffic-bot.org/fake/clicks replica-watches.net/fake/luxury/cheap fake-designer-bags.org/replica/sale warez-crack.net/keygen/download
crackedgames.org/torrent/crack serial-keygen.info/crack/software torrent-warez.net/movies/free hack-tools.org/cheat/crack game-cheats.net/hack/money
payday-cash.net/loans/fast easy-money-fast.org/cash/win bad-credit-loans.net/instant/cash get-rich-quick.info/money/bonus free-gift-cards.net/win/prize
miracle-diet.net/weight/pills cheap-cigarettes.org/buy/online xxx-cams.info/adult/free porn-stars.net/sex/videos casino-royal.info/poker/bonus""".split()
ALLOWED = """cityuniversity.org/library/research openschool.net/science/guide riverside-journal.com/news/daily morningtimes.com/news/sport weatherwatch.org/city/weather
free-software-project.org/free/download/docs softwareguide.com/docs/help/free codeforum.net/community/help history-museum.org/art/guide music-review.com/music/review
software-archive.org/download/software/free travelguide.com/city/travel/hotels slowfood-blog.net/kitchen/food gardenhelp.org/garden/guide book-review.com/books/review localsports.net/sport/news
publichealth.org/health/research/drugs familyphotos.net/photo/family techblog.com/tech/data clouddocs.org/docs/data learn-code.com/learn/code/free
worldnews.com/world/news/money libraryofbooks.net/books/history artjournal.org/art/journal carreview.com/car/auto/best jobsforum.net/jobs/community
peoples-credit-union.com/bank/loans/home citybank.com/credit/help shop-online.com/shop/store/sale videogamesworld.net/games/review videoguide.org/video/learn
infohelp.com/index/page myfirstblog.org/blog/post wikihelp.net/wiki/page pharmacy-college.org/science/health weightlifting.org/sport/training
farm-museum.org/farm/history family-food.net/kitchen/shop buycott-guide.org/buy/local best-books.net/best/books/list cheap-eats.net/food/review
girls-school.org/girls/school/sport hot-springs.org/travel/hot cash-flow-course.net/business/learn online-courses.org/learn/online mailhelp.net/mail/guide
student-loans.org/university/loans/help cinema-review.net/movies/review watchmaker.org/watches/history linkeddata.org/data/links adult-education.org/school/learn
traffic-report.net/city/traffic/news chess-club.org/games/chess national-lottery-fund.org/community/grants""".split()

#: Parts of urls that say nothing of their content, beside those of one or two letters.
SILENT = frozenset("http https www com net org info blog index html htm php".split())


def host(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``; null if none does.

    rules: (verdict, ``host/path``), a short list that goes into the plan."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, text in sorted(rules, key=lambda x: len(x[1])):  # the longest is asked last, that is first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class Segmenter:
    """The likeliest split of a name into words; unknown stretches cost more the longer they are."""

    def __init__(self, counts: dict[str, int], longest: int = 24):
        floor = max(1, round(HOST_SHARE * max(sum(counts.values()), 1 / HOST_SHARE)))
        self.counts = {**counts, **{w: max(floor, counts.get(w, 0)) for w in HOST_WORDS}}
        self.total = sum(self.counts.values())
        self.cost = {w: -math.log(n / self.total) for w, n in self.counts.items()}
        self.longest = longest
        self.split = lru_cache(maxsize=50_000)(self._split)

    def _split(self, name: str) -> tuple[str, ...]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(max(0, end - self.longest), end):
                unknown = math.log(self.total) + (end - start) * math.log(10)
                options.append((best[start][0] + self.cost.get(name[start:end], unknown), start))
            best.append(min(options))
        out, end = [], len(name)
        while end:
            start = best[end][1]
            out.append(name[start:end])
            end = start
        return tuple(reversed(out))

    def tokens(self, host: str, path: str) -> list[str]:
        names = re.findall(r"[a-z]+", f"{host} {path.lower()}")
        return [w for name in names if len(name) > 2 and name not in SILENT for w in self.split(name) if len(w) > 2]


class NaiveBayes:
    """Multinomial, with one added to each count; words that training never saw say nothing. Trained on (host, path) pairs.

    Without a ``prior`` for blocking it is the share of blocked pairs, with one added to each side."""

    def __init__(self, segmenter: Segmenter, blocked: list[tuple[str, str]], allowed: list[tuple[str, str]], prior: float | None = None):
        count = [Counter(w for u in urls for w in segmenter.tokens(*u)) for urls in (blocked, allowed)]
        seen = sorted(count[0] | count[1])
        total = [sum(c.values()) + len(seen) for c in count]
        self.odds = {w: math.log((count[0][w] + 1) / total[0]) - math.log((count[1][w] + 1) / total[1]) for w in seen}
        self.base = math.log(prior / (1 - prior)) if prior else math.log((len(blocked) + 1) / (len(allowed) + 1))

    def score(self, tokens: list[str]) -> float:
        """Log-odds of blocking."""
        return self.base + sum(self.odds.get(w, 0.0) for w in tokens)


def own_list(urls: list[str]) -> list[tuple[str, str]]:
    return [u.partition("/")[::2] for u in urls]


def fit_unigrams(pages: DataFrame, html: str = "html", most: int = MOST_WORDS) -> dict[str, int]:
    """Counts of the ``most`` commonest words of two letters or more (a to z), over the texts of all pages.

    Words are counted in each task before they meet; ``most`` rows come to the driver."""
    text = F.regexp_replace(F.lower(F.coalesce(F.col(html), F.lit(""))), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>|&[a-z0-9#]+;", " ")
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?<!\p{L})[a-z]{2,24}(?!\p{L})"), F.lit(0))).alias("word"))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(most)
    return {r["word"]: r["count"] for r in top.collect()}


def labelled_rows(rows: DataFrame, url: str, blocked: Column, most: int = TRAIN_ROWS) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(blocked, allowed) pairs of host and path, of at most ``most`` rows, those whose urls have the least hashes."""
    some = rows.select(host(F.col(url)).alias("h"), path(F.col(url)).alias("p"), blocked.alias("b")).where("b is not null").orderBy(F.xxhash64("h", "p"), "h", "p").limit(most)
    out: tuple[list, list] = ([], [])
    for r in some.collect():
        out[0 if r["b"] else 1].append((r["h"], r["p"]))
    return out


def _scores(counts: dict[str, int], blocked: list[tuple[str, str]], allowed: list[tuple[str, str]]) -> Callable[..., Column]:
    @F.pandas_udf(T.DoubleType())
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        segmenter = Segmenter(counts)
        model = NaiveBayes(segmenter, blocked, allowed)
        for hosts, paths in parts:
            yield pd.Series([model.score(segmenter.tokens(h, p)) for h, p in zip(hosts, paths, strict=True)], dtype=float)

    return run


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    url: str = "url",
    html: str | None = "html",
    keep: tuple[str, ...] = ("page_id",),
    train: tuple[list[tuple[str, str]], list[tuple[str, str]]] | None = None,
) -> DataFrame:
    """The columns ``keep``, then host, path, rule, score (log-odds of blocking), verdict.

    Words are counted in the column ``html`` first, if there is one. train: (blocked, allowed) pairs of host and path."""
    own = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    counts = fit_unigrams(pages, html) if html else {}
    parts = pages.select(*own, host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    scored = _scores(counts, *(train or (own_list(BLOCKED), own_list(ALLOWED))))
    judged = parts.withColumn("_rule", rule(F.col("host"), F.col("path"), rules)).withColumn("score", scored("host", "path"))
    learned = F.when(F.col("score") > 0, "block").otherwise("allow")
    return judged.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", F.col("_rule.rule").alias("rule"), "score", F.coalesce("_rule.verdict", learned).alias("verdict"))
