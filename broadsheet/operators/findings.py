"""Rules as queries: each gives rows of one findings table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions import constants as K
from broadsheet.functions import facts, text, urls
from broadsheet.functions.similarity import dice, jaccard, numeric_conflict
from broadsheet.functions.text import bound
from broadsheet.session import written

STORY = (
    "struct<id:string,slug:string,topic:string,reportingType:string,headline:string,deck:string,whatChanged:array<string>,"
    "whyItMatters:string,background:string,uncertainty:string,sourceIds:array<string>,sourceCount:int,confidence:string,"
    "firstPublishedAt:string,updatedAt:string,generatedBy:string,promptVersion:string,reviewed:boolean>"
)
SOURCE = (
    "struct<id:string,publisher:string,attribution:string,authors:array<string>,termsUrl:string,licenseUrl:string,"
    "title:string,url:string,sourceType:string,publishedAt:string>"
)
NOTE = "struct<id:string,storyId:string,correctedAt:string,editionVersion:int,summary:string,detail:string>"
EDITION = (
    "schemaVersion int, date string, editionVersion int, status string, publishedAt string, updatedAt string, estimatedMinutes int, "
    f"coreStoryIds array<string>, interestPools map<string,array<string>>, stories array<{STORY}>, sources array<{SOURCE}>, correctionNotes array<{NOTE}>"
)
COLUMNS = ["file", "rule_id", "severity", "story_id", "story_pos", "detail"]


#: Rows that a rule can be told from by itself, and what names the story there (none: a finding of the edition).
_STORY_OF = {"story": ("id", "pos"), "cite": ("story_id", "story_pos"), "pair": ("id", "pos"), "source": None, "note": None, "edition": None}


@dataclass(frozen=True)
class Rule:
    """An id, a severity, and what finds faults.

    Either `find`, a query that gives (file, story_id, story_pos, detail), or `by_row`: for some kinds of rows (see
    _STORY_OF) an array of the details of what is wrong with a row. Rules by row go together over one reading of it.
    """

    id: str
    severity: str
    query: Callable[[Edition], DataFrame] | None = None
    by_row: dict[str, Callable[[], Column]] | None = None

    def find(self, e: Edition) -> DataFrame:
        if self.query:
            return self.query(e)
        parts = [_by_row(e, kind, [self]).drop("rule_id", "severity") for kind in self.by_row]
        return reduce(DataFrame.unionByName, parts)


class Edition:
    """The tables of a corpus of edition documents; a document's arrays are opened once for all rules.

    keep(df, name), if given, keeps a table that several rules read, so that no rule's plan holds how it was made.
    """

    def __init__(self, editions: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df):
        self.editions = editions
        self.stories = keep(editions.select("file", "status", F.posexplode("stories").alias("pos", "s")).select("file", "status", "pos", "s.*"), "edition-stories")
        self.sources = keep(self._hosts(editions.select("file", F.posexplode("sources").alias("pos", "s")).select("file", "pos", "s.*")), "edition-sources")
        self.notes = editions.select("file", "publishedAt", "updatedAt", F.posexplode("correctionNotes").alias("pos", "n")).select("file", "publishedAt", F.col("updatedAt").alias("editionUpdatedAt"), "pos", "n.*")
        self.cites = self._cites(self.stories)
        last = Window.partitionBy("file", "id").orderBy(F.desc("pos"))
        self.source_of = self.sources.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "pos", "host")
        self.cited = keep(self.cites.join(self.source_of.withColumnRenamed("id", "source_id"), ["file", "source_id"]), "edition-cited")
        core = editions.select("file", F.posexplode("coreStoryIds").alias("rank", "id"))
        self.core = keep(core.join(self.stories, ["file", "id"]), "edition-core")
        self.pooled = editions.select("file", F.explode(F.flatten(F.map_values("interestPools"))).alias("id")).distinct().join(self.stories, ["file", "id"])
        self.files, self.minutes = editions.select("file"), editions.select("file", "estimatedMinutes")

    @staticmethod
    def _cites(stories: DataFrame) -> DataFrame:
        return stories.select("file", F.col("id").alias("story_id"), F.col("pos").alias("story_pos"), F.col("updatedAt").alias("story_updated"), F.posexplode("sourceIds").alias("cite_pos", "source_id"))

    @staticmethod
    def _hosts(sources: DataFrame) -> DataFrame:
        return sources.withColumn("host", urls.host_reach(urls.hostname(F.col("url"))))

    def rows(self, kind: str) -> DataFrame:
        if kind == "pair":
            return self.pairs().select("*", "a.id", "a.pos")
        return self.editions if kind == "edition" else {"story": self.stories, "cite": self.cited, "source": self.sources, "note": self.notes}[kind]

    def pairs(self) -> DataFrame:
        """All pairs of stories of one edition, a before b, with what pairs are told by; an edition holds a score of stories."""
        said, slugs = text.editorial_tokens(F.concat_ws(" ", "headline", "deck")), F.array_distinct(F.split("slug", "-"))
        each = self.stories.select("file", "id", "pos", "sourceIds", said.alias("said"), slugs.alias("slugs"))
        side = lambda n: each.select("file", F.struct("id", "pos", "sourceIds", "said", "slugs").alias(n))
        return side("a").join(side("b"), "file").filter("a.pos < b.pos")


def _story(df: DataFrame, detail: Column, story: str = "id", pos: str = "pos") -> DataFrame:
    return df.select("file", F.col(story).alias("story_id"), F.col(pos).alias("story_pos"), detail.cast("string").alias("detail"))


def _edition(df: DataFrame, detail: Column) -> DataFrame:
    return df.select("file", F.lit(None).cast("string").alias("story_id"), F.lit(-1).alias("story_pos"), detail.cast("string").alias("detail"))


def opened(df: DataFrame, *keep: Column | str, **array: Column | str) -> DataFrame:
    """keep and each element of an array of structs. An outer explode, as Spark would ask for the size of what a plain one
    opens in a filter before it, and so make the array twice for each row."""
    ((name, value),) = array.items()
    return df.select(*keep, F.explode_outer(value).alias(name)).filter(F.col(name).isNotNull())


def _by_row(e: Edition, kind: str, rules: list[Rule]) -> DataFrame:
    """The findings of all rules that look at one kind of rows, from one projection of it."""

    def told(r: Rule) -> Column:
        return F.transform(r.by_row[kind](), lambda d: F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), d.cast("string").alias("detail")))

    each = [told(r) for r in rules if r.by_row and kind in r.by_row]
    at = _STORY_OF[kind]
    story, pos = (F.col(at[0]), F.col(at[1])) if at else (F.lit(None).cast("string"), F.lit(-1))
    rows = opened(e.rows(kind), "file", story.alias("story_id"), pos.alias("story_pos"), r=F.concat(*each))
    return rows.select("file", "r.rule_id", "r.severity", "story_id", "story_pos", "r.detail")


def _if(wrong: Column | str, detail: Column) -> Column:
    """One detail if something is wrong, else none."""
    wrong = F.expr(wrong) if isinstance(wrong, str) else wrong
    return F.when(F.coalesce(wrong, F.lit(False)), F.array(detail.cast("string"))).otherwise(F.array().cast("array<string>"))


def _time(column: str) -> Column:
    return F.try_to_timestamp(F.col(column))


def visible_fields(story: str = "") -> Column:
    """Texts of a story that readers see, by field."""
    c = lambda n: F.col(f"{story}{n}")
    one = [F.struct(F.lit(n).alias("field"), c(n).alias("text")) for n in ("headline", "deck", "whyItMatters", "background", "uncertainty")]
    many = F.transform(c("whatChanged"), lambda t, i: F.struct(F.concat(F.lit("whatChanged."), i.cast("string")).alias("field"), t.alias("text")))
    return F.filter(F.concat(F.array(*one), many), lambda x: x["text"].isNotNull())


def story_words(word_count: Callable[[Column], Column], story: str = "") -> Column:
    c = lambda n: F.coalesce(F.col(f"{story}{n}"), F.lit(""))
    changed = F.aggregate(F.col(f"{story}whatChanged"), F.lit(0), lambda a, t: a + word_count(t))
    return word_count(c("deck")) + changed + word_count(c("whyItMatters")) + word_count(c("uncertainty"))


def visible_stories(e: Edition) -> DataFrame:
    """The core and the two wordiest pooled stories, as the estimate of minutes counts them."""
    core, pooled = (t.select("file", "id", story_words(text.rule_word_count).alias("words")) for t in (e.core, e.pooled))
    best = Window.partitionBy("file").orderBy(F.desc("words"), "id")
    return core.unionByName(pooled.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= K.POOLED_VISIBLE).drop("_r"))


def _duplicate_slug(e: Edition) -> DataFrame:
    w = Window.partitionBy("file", "slug").orderBy("pos")
    return _story(e.stories.withColumn("_r", F.row_number().over(w)).filter("_r > 1"), F.col("slug"))


def _publisher_leads(e: Edition) -> DataFrame:
    lead = e.core.select("file", "id", F.try_element_at("sourceIds", F.lit(1)).alias("source_id")).join(e.source_of.select("file", F.col("id").alias("source_id"), "publisher"), ["file", "source_id"])
    return _edition(lead.groupBy("file", "publisher").agg(F.count("*").alias("n")).filter(F.col("n") > K.PER_PUBLISHER), F.col("publisher"))


def _publisher_stories(e: Edition) -> DataFrame:
    core = e.core.select("file", F.col("id").alias("story_id"))
    n = e.cited.join(core, ["file", "story_id"]).groupBy("file", "publisher").agg(F.count_distinct("story_id").alias("n"))
    return _edition(n.filter(F.col("n") > K.PER_PUBLISHER), F.col("publisher"))


def _min_publishers(e: Edition) -> DataFrame:
    n = e.files.join(e.cited.groupBy("file").agg(F.count_distinct("publisher").alias("n")), "file", "left")
    return _edition(n.filter(F.coalesce("n", F.lit(0)) < K.MIN_PUBLISHERS), F.coalesce("n", F.lit(0)))


def _shared_majority() -> Column:
    shared = F.size(F.array_intersect("a.sourceIds", "b.sourceIds"))
    share = shared / F.least(F.size("a.sourceIds"), F.size("b.sourceIds"))
    return _if((shared >= K.SHARED_SOURCES) & (share >= K.SHARED_SHARE), F.col("b.id"))


def _headline_score() -> Column:
    return dice(F.col("a.said"), F.col("b.said"), both_empty=0.0) >= K.HEADLINE_DICE


def _slug_score() -> Column:
    a, b = F.col("a.slugs"), F.col("b.slugs")
    return (F.size(F.array_intersect(a, b)) >= K.SLUG_WORDS) & (jaccard(a, b) >= K.SLUG_JACCARD)


def _minutes(e: Edition) -> DataFrame:
    words = visible_stories(e).groupBy("file").agg(F.sum("words").alias("words"))
    both = e.minutes.join(words, "file", "left")
    want = F.ceil(F.coalesce("words", F.lit(0)) / K.WORDS_PER_MINUTE)
    return _edition(both.filter(F.col("estimatedMinutes") != want), want)


def _source_hosts(e: Edition) -> DataFrame:
    return e.rows("source")


def _host_rule(kind: str) -> dict[str, Callable[[], Column]]:
    return {"source": lambda: _if(F.col("host.kind") == kind, F.col("id"))}


def _mixed_hosts(e: Edition) -> DataFrame:
    by = _source_hosts(e).groupBy("file").agg(F.sort_array(F.collect_set(F.when(F.col("host.kind") == "reserved-name", F.col("id")))).alias("r"), F.sort_array(F.collect_set(F.when(F.col("host.kind") == "name", F.col("id")))).alias("n"))
    return _edition(by.filter((F.size("r") > 0) & (F.size("n") > 0)), F.concat_ws(",", "r"))


def _sample_hosts(e: Edition) -> DataFrame:
    return _edition(_source_hosts(e).groupBy("file").agg(F.every(F.col("host.kind") == "reserved-name").alias("all")).filter("all"), F.lit("all hosts are reserved"))


def _official_only(e: Edition) -> DataFrame:
    by = e.cited.groupBy("file", "story_id", "story_pos").agg(F.every(F.col("sourceType") == "official").alias("all"))
    found = by.filter("all").join(e.stories.select("file", F.col("id").alias("story_id"), "reportingType"), ["file", "story_id"]).filter("reportingType <> 'official'")
    return _story(found, F.col("reportingType"), "story_id", "story_pos")


def _shared_source(e: Edition) -> DataFrame:
    by = e.cites.groupBy("file", "source_id").agg(F.count_distinct("story_id").alias("n")).filter("n > 1")
    return _edition(by, F.col("source_id"))


#: Markup in what readers see of stories (by field), sources and notes.
_MARKUP = {
    "story": lambda: F.transform(F.filter(visible_fields(), lambda f: text.has_markup(f["text"])), lambda f: f["field"]),
    "source": lambda: _if(text.has_markup(F.concat_ws(" \u001f ", "title", "publisher")), F.col("id")),
    "note": lambda: _if(text.has_markup(F.concat_ws(" \u001f ", "summary", "detail")), F.col("id")),
}


def _all_hard_news(e: Edition) -> DataFrame:
    by = e.core.groupBy("file").agg(F.every(text.is_hard_news(F.concat_ws(" ", "headline", "deck"))).alias("all"))
    return _edition(by.filter("all"), F.lit("every core story"))


def _note_story(e: Edition) -> DataFrame:
    both = e.notes.join(e.stories.select("file", F.col("id").alias("storyId"), F.col("pos").alias("story_pos"), F.col("updatedAt").alias("storyUpdated")), ["file", "storyId"])
    return _story(both.filter(_time("storyUpdated") < _time("correctedAt")), F.col("id"), "storyId", "story_pos")


def _no_notes(where: str) -> dict[str, Callable[[], Column]]:
    return {"edition": lambda: _if(f"coalesce(size(correctionNotes), 0) <= 0 and {where}", F.col("status"))}


def _long_paragraphs() -> Column:
    long = F.transform("whatChanged", lambda p, i: F.when(text.rule_word_count(p) > K.MAX_PARAGRAPH_WORDS, i.cast("string")))
    return F.coalesce(F.array_compact(long), F.array().cast("array<string>"))


EDITION_RULES = [
    Rule("structural/duplicate-slug", "blocking", _duplicate_slug),
    Rule("structural/unreviewed-story-gate", "blocking", by_row={"story": lambda: _if("status in ('published', 'corrected') and not coalesce(reviewed, false)", F.col("status"))}),
    Rule("structural/source-not-after-story-update", "blocking", by_row={"cite": lambda: _if(_time("publishedAt") > _time("story_updated"), F.col("source_id"))}),
    Rule("structural/generated-provenance-pair", "blocking", by_row={"story": lambda: _if("(generatedBy is null) <> (promptVersion is null)", F.coalesce("generatedBy", "promptVersion"))}),
    Rule("structural/no-markup-in-text", "blocking", by_row=_MARKUP),
    Rule("structural/disputed-requires-uncertainty", "blocking", by_row={"story": lambda: _if("confidence = 'disputed' and uncertainty is null", F.col("confidence"))}),
    Rule("structural/official-source-only-needs-official-label", "blocking", _official_only),
    Rule("diversity/min-publishers", "blocking", _min_publishers),
    Rule("diversity/publisher-primary-cap", "blocking", _publisher_leads),
    Rule("diversity/publisher-concentration", "warning", _publisher_stories),
    Rule("diversity/topic-cap", "blocking", lambda e: _edition(e.core.groupBy("file", "topic").agg(F.count("*").alias("n")).filter(F.col("n") > K.PER_TOPIC), F.col("topic"))),
    Rule("diversity/all-hard-news", "blocking", _all_hard_news),
    Rule("duplicate/shared-source-majority", "blocking", by_row={"pair": _shared_majority}),
    Rule("duplicate/shared-source", "warning", _shared_source),
    Rule("duplicate/headline-similarity", "warning", by_row={"pair": lambda: _if(_headline_score(), F.col("b.id"))}),
    Rule("duplicate/slug-similarity", "warning", by_row={"pair": lambda: _if(_slug_score(), F.col("b.id"))}),
    Rule("length/estimated-minutes", "blocking", _minutes),
    Rule("length/deck-one-line", "warning", by_row={"story": lambda: _if(text.rule_word_count(F.col("deck")) > K.MAX_DECK_WORDS, F.lit("deck"))}),
    Rule("length/what-changed-paragraph-words", "warning", by_row={"story": _long_paragraphs}),
    Rule("length/why-it-matters-one-paragraph", "warning", by_row={"story": lambda: _if(text.rule_word_count(F.col("whyItMatters")) > K.MAX_WHY_WORDS, F.lit("whyItMatters"))}),
    Rule("url/no-credentials", "blocking", by_row={"source": lambda: _if(F.col("url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@"), F.col("id"))}),
    Rule("url/no-ip-literal", "blocking", by_row=_host_rule("address")),
    Rule("url/no-private-host", "blocking", by_row=_host_rule("private-name")),
    Rule("url/mixed-host-classes", "blocking", _mixed_hosts),
    Rule("url/sample-data-hosts", "warning", _sample_hosts),
    Rule("url/https-only", "warning", by_row={"source": lambda: _if(F.col("url").rlike("(?i)^http://"), F.col("id"))}),
    Rule("correction/status-requires-note", "blocking", by_row=_no_notes("status = 'corrected'")),
    Rule("correction/version-requires-note", "blocking", by_row=_no_notes("editionVersion >= 2")),
    Rule("correction/corrected-after-published", "blocking", by_row={"note": lambda: _if(_time("correctedAt") < _time("publishedAt"), F.col("id"))}),
    Rule("correction/corrected-within-updated", "blocking", by_row={"note": lambda: _if(_time("correctedAt") > _time("editionUpdatedAt"), F.col("id"))}),
    Rule("correction/story-reflects-correction", "blocking", _note_story),
]


def schema_findings(e: Edition) -> DataFrame:
    """What the form of an edition forbids: unresolved, repeated or orphaned references, and contradictions."""
    core = e.editions.select("file", "coreStoryIds", "interestPools", "stories", "status", "editionVersion", "publishedAt", "updatedAt", "sources", "correctionNotes")
    ids = F.transform("stories", lambda s: s["id"])
    pools = F.flatten(F.map_values("interestPools"))
    missing = lambda xs: F.array_except(xs, ids)
    cites = F.array_distinct(F.flatten(F.transform("stories", lambda s: s["sourceIds"])))
    repeated = lambda xs: F.size(xs) != F.size(F.array_distinct(xs))
    checks = {
        "eight-core-stories": F.size("coreStoryIds") != K.CORE_STORIES,
        "repeated-story-id": repeated(ids),
        "repeated-core-id": repeated(F.col("coreStoryIds")),
        "repeated-source-id": repeated(F.transform("sources", lambda s: s["id"])),
        "core-unresolved": F.size(missing(F.col("coreStoryIds"))) > 0,
        "pool-unresolved": F.size(missing(pools)) > 0,
        "pool-empty": F.exists(F.map_values("interestPools"), lambda p: F.size(p) == 0),
        "pool-of-core": F.size(F.array_intersect(pools, F.col("coreStoryIds"))) > 0,
        "too-few-pooled": F.size(F.array_distinct(pools)) < 2,
        "orphan-story": F.size(F.array_except(ids, F.concat("coreStoryIds", pools))) > 0,
        "citation-unresolved": F.size(F.array_except(cites, F.transform("sources", lambda s: s["id"]))) > 0,
        "published-unreviewed": F.col("status").isin("published", "corrected") & F.exists("stories", lambda s: ~F.coalesce(s["reviewed"], F.lit(False))),
        "correction-unresolved": F.size(missing(F.transform("correctionNotes", lambda n: n["storyId"]))) > 0,
        "correction-ahead": F.exists("correctionNotes", lambda n: n["editionVersion"] > F.col("editionVersion")),
        "notes-need-corrected": (F.size("correctionNotes") > 0) & ((F.col("status") != "corrected") | (F.col("editionVersion") < 2)),
        "updated-before-published": _time("updatedAt") < _time("publishedAt"),
        "story-counts": F.exists("stories", lambda s: (s["sourceCount"] != F.size(s["sourceIds"])) | (F.size(F.array_distinct(s["sourceIds"])) != F.size(s["sourceIds"]))),
        "story-confidence": F.exists("stories", lambda s: ((s["confidence"] == "single-source") & (s["sourceCount"] != 1)) | (s["confidence"].isin("multi-source", "disputed") & (s["sourceCount"] < 2))),
        "pool-topic": F.exists(F.map_entries("interestPools"), lambda p: F.exists(p["value"], lambda i: F.exists("stories", lambda s: (s["id"] == i) & (s["topic"] != p["key"])))),
    }
    fired = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return _edition(core.select("file", F.explode(fired).alias("check")), F.col("check"))


#: Rules of their own whose plans the driver holds at a time.
FEW = 4


def edition_findings(editions: DataFrame) -> DataFrame:
    """All findings of a corpus of editions (file and the columns of EDITION), one row each.

    A few rules at a time are run and their findings written, so that the driver never holds the plans of all.
    """
    e = Edition(editions, written)
    tell = lambda found, rule, severity: found.select("file", F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), "story_id", "story_pos", "detail")
    named = editions.filter(~F.col("file").endswith(F.concat("date", F.lit(".json"))))
    asked = [tell(r.query(e), r.id, r.severity) for r in EDITION_RULES if r.query]
    asked += [tell(schema_findings(e), "edition/schema", "blocking"), tell(_edition(named, F.col("date")), "structural/file-name-matches-date", "blocking")]
    steps = [asked[at : at + FEW] for at in range(0, len(asked), FEW)] + [[_by_row(e, kind, EDITION_RULES)] for kind in _STORY_OF]
    return reduce(DataFrame.unionByName, [written(reduce(DataFrame.unionByName, step), "findings") for step in steps])


def ordered(findings: DataFrame) -> DataFrame:
    """Edition-level findings first, then by story, then by rule."""
    return findings.orderBy("file", "story_pos", "rule_id", "detail")


def report(editions: DataFrame, findings: DataFrame) -> DataFrame:
    """One row a file: counts by severity, and whether it may be published."""
    sample = F.count_if((F.col("rule_id") == "url/sample-data-hosts"))
    by = findings.groupBy("file").agg(F.count_if(F.col("severity") == "blocking").alias("blocking"), F.count_if(F.col("severity") == "warning").alias("warnings"), sample.alias("sample"))
    both = editions.select("file", "date").join(by, "file", "left").na.fill(0, ["blocking", "warnings", "sample"])
    return both.select("file", "date", "blocking", "warnings", ((F.col("blocking") == 0) & (F.col("sample") == 0)).alias("publishable"))


def exit_code(reports: DataFrame, publish: bool = False) -> int:
    """0 in order, 1 something blocks (or, to publish, isn't publishable), 3 nothing was validated."""
    r = reports.agg(F.count("*").alias("n"), F.coalesce(F.sum("blocking"), F.lit(0)).alias("b"), F.count_if(~F.col("publishable")).alias("u")).first()
    return 3 if not r["n"] else 1 if r["b"] or (publish and r["u"]) else 0


# --- source registry -------------------------------------------------------------------------------------------------


def registry_findings(registry: DataFrame) -> DataFrame:
    """registry(source_id, feedUrl, siteUrl, termsUrl, licenseUrl, active, sample, permittedUse) -> rule_id, severity, source_id, detail."""
    names = ["feedUrl", "siteUrl", "termsUrl", "licenseUrl"]
    links = registry.select("source_id", "sample", F.explode(F.array(*[F.struct(F.lit(n).alias("path"), F.col(n).alias("url")) for n in names])).alias("u")).filter("u.url is not null")
    hosts = links.select("source_id", "sample", "u.path", urls.host_reach(urls.hostname(F.col("u.url"))).alias("host"))
    feed = hosts.filter("path = 'feedUrl'")
    sample = F.coalesce(F.col("sample"), F.lit(False))

    def out(df: DataFrame, rule: str, severity: str, detail: Column) -> DataFrame:
        return df.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), "source_id", detail.cast("string").alias("detail"))

    kinds = feed.agg(F.count_if(F.col("host.kind") == "reserved-name").alias("r"), F.count_if(F.col("host.kind") == "name").alias("n")).filter("r > 0 and n > 0").withColumn("source_id", F.lit(None).cast("string"))
    folded = registry.select("source_id", urls.feed_key(F.col("feedUrl")).alias("href"), urls.folded_feed_key(F.col("feedUrl")).alias("key"))
    near = folded.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("href").alias("hrefs"), F.sort_array(F.collect_list("source_id")).alias("ids")).filter("n >= 2 and hrefs >= 2").withColumn("source_id", F.col("ids")[0])
    notes = registry.filter("permittedUse is not null").groupBy("permittedUse").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("source_id")).alias("ids")).filter("n >= 2").withColumn("source_id", F.col("ids")[0])
    empty = registry.agg(F.count("*").alias("n")).filter("n = 0").withColumn("source_id", F.lit(None).cast("string"))
    parts = [
        out(hosts.filter("host.kind = 'address'"), "url/no-address-literal", "blocking", F.col("path")),
        out(hosts.filter("host.kind = 'private-name'"), "url/no-private-host", "blocking", F.col("path")),
        out(feed.filter(sample & (F.col("host.kind") != "reserved-name")), "sample/reserved-host-required", "blocking", F.col("host.host")),
        out(hosts.filter(~sample & (F.col("host.kind") == "reserved-name")), "sample/reserved-host-only", "blocking", F.col("path")),
        out(kinds, "url/mixed-host-classes", "blocking", F.concat_ws("/", "r", "n")),
        out(near, "duplicate/near-feed-url", "warning", F.concat_ws(",", "ids")),
        out(notes, "duplicate/permitted-use-note", "warning", F.concat_ws(",", "ids")),
        out(empty, "registry/no-sources", "warning", F.lit("no sources")),
    ]
    return reduce(DataFrame.unionByName, parts)


def fetchable(registry: DataFrame, findings: DataFrame) -> DataFrame:
    """Active sources that are no samples, without a blocking finding on them or on the registry as a whole."""
    blocking = findings.filter("severity = 'blocking'")
    whole = blocking.filter("source_id is null").select(F.lit(1).alias("one")).limit(1)
    ok = registry.filter("active and not coalesce(sample, false)").join(blocking.select("source_id").distinct(), "source_id", "left_anti")
    return ok.withColumn("one", F.lit(1)).join(F.broadcast(whole), "one", "left_anti").drop("one")


def permitted(items: DataFrame, registry: DataFrame, use: str) -> DataFrame:
    """Items whose source is active and permits a use."""
    may = registry.filter(F.col("active") & F.array_contains("permittedUses", use)).select("source_id")
    return items.join(may, "source_id", "left_semi")


# --- factual support --------------------------------------------------------------------------------------------------

OPINION = r"(?i)(?<![A-Za-z0-9_])(opinion|editorial|column|view|analysis|perspective)(?![A-Za-z0-9_])"


def cluster_text() -> Column:
    """Sources with and without their dashes, then each item's source, title and description."""
    both = lambda s: F.concat_ws(" ", s, F.replace(s, F.lit("-"), F.lit(" ")))
    of_items = F.transform("items", lambda i: F.concat_ws(" ", both(i["source_id"]), i["title"], F.coalesce(i["description"], F.lit(""))))
    return F.concat_ws(" ", F.concat(F.transform("sources", both), of_items))


def story_text() -> Column:
    return F.concat_ws(" ", F.concat(F.array("headline", "deck"), F.coalesce("whatChanged", F.array()), F.array("whyItMatters"), F.array_compact(F.array("background", "uncertainty"))))


def _loose_numbers() -> Column:
    """Numbers of a story that its cluster has neither as written nor in canonical form."""
    forms = lambda known: F.concat(F.transform(known, F.lower), facts.normalize_numbers(known))
    unknown = lambda said, forms: F.filter(said, lambda x: ~F.array_contains(forms, F.lower(x)) & ~F.array_contains(forms, facts.canonical_number(x)))
    return bound(bound(facts.numbers(F.col("_cluster")), forms), lambda f: bound(facts.numbers(F.col("_story")), lambda said: unknown(said, f)))


def _loose_names() -> Column:
    """Names of a story that its cluster has neither as a phrase nor by all their words."""

    def ungrounded(name: Column, low: Column) -> Column:
        words = F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(K.COMMON_INITIAL_WORDS))
        return ~low.contains(F.lower(name)) & ~bound(words, lambda ws: (F.size(ws) > 0) & F.forall(ws, lambda w: low.contains(w)))

    return bound(F.lower("_cluster"), lambda low: F.filter(facts.named_entities(F.col("_story")), lambda n: ungrounded(n, low)))


def _loose_dates() -> Column:
    """Dates of a story that its cluster doesn't have, nor its items as their dates or weekdays."""
    days = F.flatten(F.transform("items", lambda i: F.when(i["published_at"].isNull(), F.array().cast("array<string>")).otherwise(F.array(F.date_format(i["published_at"], "yyyy-MM-dd"), F.lower(F.date_format(F.from_utc_timestamp(i["published_at"], K.EDITORIAL_ZONE), "EEEE"))))))
    known = F.transform(F.concat(facts.dates(F.col("_cluster")), days), F.lower)
    return bound(known, lambda k: F.filter(facts.dates(F.col("_story")), lambda d: ~F.array_contains(k, F.lower(d))))


def _conflict() -> Column:
    """Two items name numbers and share none."""
    numbers = F.transform("items", lambda i: text.title_tokens(i["title"])["numbers"])
    return bound(numbers, lambda all: F.exists(all, lambda a: F.exists(all, lambda b: numeric_conflict(a, b))))


FACT_RULES = ["fact/number-containment", "fact/entity-containment", "fact/date-containment", "fact/source-attribution", "fact/editorial-alignment", "fact/uncertainty-on-conflict"]


def factual_findings(stories: DataFrame, rules: list[str] = FACT_RULES) -> DataFrame:
    """stories(story_id, headline, …, sources, items array<struct<source_id,title,description,published_at>>) -> findings.

    Everything a story says must be in its cluster: numbers as written or in canonical form, names as a phrase or by all
    their words, dates as written, as the items' dates or weekdays; sources must be the cluster's. What rules that aren't
    asked for look at is not made.
    """
    t = stories.select("*", story_text().alias("_story"), cluster_text().alias("_cluster"))
    allowed = F.when(F.size("sources") > 0, F.col("sources")).otherwise(F.transform("items", lambda i: i["source_id"]))
    opinion = (F.size("items") > 0) & F.forall("items", lambda i: i["title"].rlike(OPINION))
    settled = (F.length(text.trimmed(F.coalesce("uncertainty", F.lit("")))) < 20) & (F.col("confidence") != "disputed")
    found = lambda n, tokens: F.struct(n.alias("n"), tokens.alias("tokens"))
    loose = lambda tokens: bound(tokens, lambda xs: found(F.size(xs), xs))
    wrong = lambda fault: found(fault.cast("int"), F.array().cast("array<string>"))
    checks = {
        "fact/number-containment": ("blocking", lambda: loose(_loose_numbers())),
        "fact/entity-containment": ("blocking", lambda: loose(_loose_names())),
        "fact/date-containment": ("warning", lambda: loose(_loose_dates())),
        "fact/source-attribution": ("blocking", lambda: bound(F.array_except("sourceIds", allowed), lambda xs: found(F.when(F.size("sourceIds") == 0, 1).otherwise(F.size(xs)), xs))),
        "fact/editorial-alignment": ("blocking", lambda: wrong(opinion & (F.col("reportingType") == "reporting"))),
        "fact/uncertainty-on-conflict": ("blocking", lambda: wrong(settled & _conflict())),
    }
    rows = [F.struct(F.lit(r).alias("rule_id"), F.lit(checks[r][0]).alias("severity"), checks[r][1]().alias("f")) for r in rules]
    told = t.select("story_id", F.filter(F.array(*rows), lambda r: r["f"]["n"] > 0).alias("rows"))
    return opened(told, "story_id", r="rows").select("story_id", "r.rule_id", "r.severity", F.col("r.f.tokens").alias("ungrounded"))


def factual_metrics(stories: DataFrame, findings: DataFrame) -> DataFrame:
    """One row a story: findings by severity, ungrounded tokens, and whether its sources are all known."""
    by = findings.groupBy("story_id").agg(F.count_if(F.col("severity") == "blocking").alias("blocking"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.sum(F.size("ungrounded")).alias("ungrounded"), F.max((F.col("rule_id") == "fact/source-attribution").cast("int")).alias("_bad"))
    out = stories.select("story_id").join(by, "story_id", "left").na.fill(0)
    return out.select("story_id", "blocking", "warnings", "ungrounded", (1 - F.col("_bad")).alias("attribution_score"))


# --- source health ----------------------------------------------------------------------------------------------------


def source_health(fetches: DataFrame, latest: DataFrame | None, reference: Column) -> DataFrame:
    """fetches(source_id, kind success/not-modified/failure, duration_ms), latest(source_id, n_items, latest_at) -> status and warnings."""
    j = fetches.join(latest, "source_id", "left") if latest is not None else fetches.withColumn("n_items", F.lit(None).cast("long")).withColumn("latest_at", F.lit(None).cast("timestamp"))
    counted = latest is not None
    failed = F.col("kind") == "failure"
    warnings = F.array_compact(F.array(
        F.when(failed, "fetch/failed"),
        F.when(~failed & (F.col("duration_ms") > K.SLOW_MS), "latency/high"),
        F.when((F.col("kind") == "success") & F.lit(counted) & (F.coalesce("n_items", F.lit(0)) == 0), "items/empty"),
        F.when(~failed & (F.unix_millis(reference) - F.unix_millis("latest_at") > K.STALE_HOURS * 3600000), "staleness/old"),
    ))
    out = j.withColumn("warnings", warnings)
    return out.withColumn("status", F.when(failed, "failing").when(F.size("warnings") > 0, "warning").otherwise("healthy")).select("source_id", "status", "warnings", "n_items", "latest_at")


def health_rollup(health: DataFrame) -> DataFrame:
    return health.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("healthy", "warning", "failing")])
