"""URL filters in DataFrame expressions only: listed rules, then a logistic regression.

The regression looks at hashed character n-grams of host and path. It is fitted from a small
labelled table of URLs by gradient descent; its weights are a bounded array that goes into the
scoring expression as a constant.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rules (host, path, verdict), then the labelled URLs (1: to be blocked). The table was written down by kinds of
# hosts: fraud, gambling, pornography, drugs, counterfeits, malware, advertising; public bodies, learning, clubs, crafts.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: The lowest of 0.5, 0.6 ... 0.9 at which at most 2 of 100 ordinary rows were blocked by a fit that shares no word of a host with them.
BLOCK_AT = 0.9
BLOCKED = """secure-bank-login.example/verify account-update-now.example/signin paypal-confirm.example/login.php appleid-locked.example/unlock wallet-restore.example/seed
mail-quota-full.example/upgrade parcel-customs-fee.example/pay tax-refund-portal.example/claim sms-voucher.example/redeem gift-card-giveaway.example/claim
lucky-sweepstakes.example/enter you-are-chosen.example/prize millionaire-formula.example/join bitcoin-doubling.example/send forex-robot-profit.example/signup
binary-options-expert.example/join work-at-home-riches.example/signup debt-vanish.example/apply instant-payday.example/apply loan-without-check.example/apply
slot-machines-online.example/play roulette-royale.example/play poker-jackpot.example/bonus blackjack-vip.example/bonus bingo-billionaire.example/bonus
sportsbook-odds.example/bonus lottery-syndicate.example/buy scratchcards.example/play baccarat-live.example/play highroller-club.example/bonus
hot-singles-nearby.example/join xxx-tube.example/watch porn-gallery.example/watch webcam-girls.example/live escort-directory.example/live
nude-leaks.example/watch erotic-chat.example/live milf-dating.example/join fetish-clips.example/watch sexy-stories.example/read
viagra-express.example/order cialis-generic.example/order buy-tramadol.example/order xanax-overnight.example/order steroids-shop.example/buy
slimming-tea-miracle.example/order hair-regrowth-secret.example/buy anti-aging-serum-trial.example/buy keto-gummies.example/order detox-patch.example/buy
replica-watches.example/buy fake-rolex.example/buy designer-handbags-outlet.example/buy counterfeit-sneakers.example/buy discount-rayban.example/buy
cracked-software.example/download keygen-serials.example/download warez-archive.example/download torrent-movies-hd.example/download nulled-themes.example/download
game-cheats-hack.example/download codec-update-required.example/install flash-player-setup.example/install driver-booster-pro.example/install registry-cleaner.example/install
your-pc-is-infected.example/scan antivirus-alert.example/scan support-hotline-call.example/call browser-locked-warning.example/call ransom-decryptor.example/pay
popunder-network.example/click banner-exchange.example/click pixel-beacon.example/collect cookie-sync.example/collect clickthrough-rotator.example/redirect
affiliate-redirector.example/redirect traffic-broker.example/redirect doorway-pages.example/redirect backlinks-bulk.example/order article-spinner.example/order
buy-followers.example/order fake-reviews.example/order mass-mailer.example/send email-harvester.example/list proxy-list-dump.example/list
clickbait-shock.example/watch celebrity-scandal.example/watch miracle-cure-doctors-hate.example/read psychic-hotline.example/call love-spell-caster.example/order"""
ORDINARY = """city-library.example/catalogue national-museum.example/visit university-physics.example/courses weather-service.example/forecast botanical-gardens.example/visit
river-conservation.example/about town-council.example/minutes primary-school.example/timetable choir-rehearsals.example/calendar chess-federation.example/results
railway-timetables.example/search bicycle-repair.example/manual sourdough-baking.example/recipes mountain-huts.example/map astronomy-society.example/lectures
open-data-portal.example/datasets compiler-design.example/docs linear-algebra.example/lectures poetry-foundation.example/archive theatre-company.example/programme
orchestra-season.example/programme harbour-authority.example/tides geology-survey.example/reports translation-studies.example/journal architecture-review.example/journal
public-transport.example/map blood-donation.example/calendar hospital-trust.example/contact dental-practice.example/contact veterinary-clinic.example/contact
local-newspaper.example/news parliament-debates.example/archive court-decisions.example/archive constitutional-law.example/journal election-results.example/results
climate-science.example/reports marine-biology.example/reports bird-watching.example/sightings beekeeping-association.example/about forest-walks.example/map
carpentry-workshop.example/manual knitting-patterns.example/recipes pottery-studio.example/about watercolour-painting.example/gallery photography-club.example/gallery
history-timeline.example/archive genealogy-records.example/search cathedral-archives.example/archive medieval-manuscripts.example/gallery archaeology-digs.example/reports
cooking-school.example/courses vegetable-recipes.example/recipes tea-plantation.example/about olive-growers.example/about cheese-dairy.example/visit
language-exchange.example/about grammar-handbook.example/docs dictionary-project.example/search sign-language.example/courses reading-group.example/calendar
software-foundation.example/docs database-manual.example/docs operating-systems.example/lectures network-protocols.example/docs robotics-lab.example/reports
mathematics-olympiad.example/results statistics-office.example/datasets census-bureau.example/datasets cartography-atlas.example/map satellite-imagery.example/datasets
volunteer-firefighters.example/calendar mountain-rescue.example/contact sailing-school.example/courses rowing-regatta.example/results swimming-lessons.example/timetable
racetrack-history.example/archive windmill-museum.example/visit farmhouse-kitchen.example/recipes adulthood-psychology.example/journal freedom-of-press.example/news
spamalot-musical.example/programme alphabets-exhibition.example/gallery loads-engineering.example/manual cheapside-walks.example/map pillsbury-biography.example/read
kindergarten-songs.example/recipes orthopaedic-journal.example/journal philosophy-seminar.example/lectures economics-review.example/journal sociology-dept.example/courses"""


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): between the first :// and /, ?, # or the end, A-Z lower-cased; then up to ? or #. Both empty without ://."""
    u = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(u, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(u, pattern, 2)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null. Rules are a short list that goes into the plan."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def features(host: str, path: str, buckets: int) -> str:
    """SQL for the hashed 3- and 4-grams of host and path (array<int>), each part marked at both ends."""
    grams = []
    for mark, col in (("<", host), (">", path)):
        c = f"split(concat('{mark}', {col}, '{mark}'), '')"
        rest = lambda k: f"slice({c}, {k}, greatest(size({c}) - {k - 1}, 0))"  # noqa: B023,E731
        three = f"zip_with(zip_with({c}, {rest(2)}, (a, b) -> concat(a, b)), {rest(3)}, (a, b) -> concat(a, b))"
        four = f"zip_with({three}, {rest(4)}, (a, b) -> concat(a, b))"
        grams += [f"filter({three}, g -> g is not null)", f"filter({four}, g -> g is not null)"]
    return f"transform(concat({', '.join(grams)}), g -> cast(pmod(xxhash64(g), {buckets}) as int))"


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): the labelled table above, each host also with prefixes and pages that say nothing, by the same rule for both labels, so that these teach nothing."""
    rows = []
    for text, label in ((BLOCKED, 1), (ORDINARY, 0)):
        for i, url in enumerate(text.split()):
            name = url.partition(".")[0]
            plain = f"{('www.', 'm.', 'blog.', '')[i % 4]}{name}.example.{('com', 'net', 'org')[i % 3]}/{('en', 'de', 'fr', 'es')[i // 4 % 4]}/{i * 7 % 97}"
            rows += [(url, label), (plain, label), (f"{name}.example.{('org', 'com', 'net')[i % 3]}/", label)]
    values = ", ".join(f"('https://{u}', {y})" for u, y in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


def _constant(values: list[float]) -> str:
    return f"from_json('{json.dumps([round(x, 5) for x in values])}', 'array<double>')"


def _logit(f: str, weights: list[float], bias: float) -> str:
    return f"({bias} + aggregate({f}, 0D, (s, i) -> s + element_at({_constant(weights)}, i + 1)) / sqrt(greatest(size({f}), 1)))"


def fit(labelled: DataFrame, buckets: int = 1 << 15, steps: int = 60, rate: float = 6.0, l2: float = 0.002, most: int = 10_000) -> tuple[list[float], float]:
    """(weights, bias) of the regression from (url, label) of at most ``most`` rows, those whose urls hash lowest.

    Spark hashes the n-grams in one job; the descent over these few lists is plain arithmetic. Null
    labels don't count; an empty table gives weights of 0.
    """
    host, path = parts(F.col("url"))
    rows = labelled.where("label is not null").select(F.col("label").cast("double").alias("y"), host.alias("h"), path.alias("p"), F.xxhash64("url").alias("k")).orderBy("k", "h", "p", "y").limit(most)
    table = [(r["y"], r["f"], math.sqrt(max(1, len(r["f"])))) for r in rows.select("y", F.expr(features("h", "p", buckets)).alias("f")).collect()]
    weights, bias = [0.0] * buckets, 0.0
    for _ in range(steps if table else 0):
        slope, errors = {}, 0.0
        for y, f, root in table:
            e = y - 1 / (1 + math.exp(-(bias + sum(weights[i] for i in f) / root)))
            errors += e
            for i in f:
                slope[i] = slope.get(i, 0.0) + e / root
        bias += rate * errors / len(table) * 0.1
        weights = [w * (1 - rate * l2) for w in weights]
        for i, g in slope.items():
            weights[i] += rate * g / math.sqrt(len(table))
    return weights, bias


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, url_col: str = "url", id_col: str = "page_id", buckets: int = 1 << 15, block_at: float = BLOCK_AT) -> DataFrame:
    """(id, host, path, rule, verdict, score), one row for each row of pages.

    The longest rule that fits decides; else the regression blocks at a score of ``block_at`` or more, which is set so high that next to no
    ordinary row is blocked: a table this small tells little of names whose words it doesn't hold. A null
    url or one without :// has an empty host and path and is judged like any other. Repeated rows
    are judged alike; urls of any length are looked at whole; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    weights, bias = fit(labelled if labelled is not None else labelled_urls(pages.sparkSession), buckets)
    host, path = parts(F.col(url_col))
    d = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    d = d.withColumn("__f", F.expr(features("host", "path", buckets))).withColumn("__r", rule_for(F.col("host"), F.col("path")) if rules is RULES else rule_for(F.col("host"), F.col("path"), rules))
    score = F.expr(f"1 / (1 + exp(-{_logit('__f', weights, bias)}))")
    d = d.withColumn("score", score)
    return d.select(id_col, "host", "path", F.col("__r.rule").alias("rule"), F.coalesce(F.col("__r.verdict"), F.when(F.col("score") >= block_at, "block").otherwise("allow")).alias("verdict"), "score")
