"""Snapshots of scholarly indexes converted to records: one function a source, all native.

Every record has source, title, authors (array of given, family), journal, publisher, year, volume, number, pages, type,
doi, url, arxiv_id, issn, venue_key, method, is_preprint_of, and the flags structured and order_reliable that say how far
its names can be trusted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions.identifiers import arxiv_id, doi_normalize, issn_normalize, none_if_empty, stream_key, tilde_family
from citeweave.functions.venues import is_preprint_venue
from citeweave.operators.detect import acceptance

PEOPLE = "array<struct<given:string,family:string>>"


def untag(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"<[^>]+>", ""))


def person(given: Column, family: Column) -> Column:
    return F.struct(given.cast("string").alias("given"), family.cast("string").alias("family"))


def flat_name(name: Column) -> Column:
    """A display name: behind the last space the family, before it the given name; a homonym number dropped."""
    n = F.regexp_replace(F.trim(name), r"\s+[0-9]{4}$", "")
    return F.when(F.contains(n, F.lit(",")), person(F.trim(F.split_part(n, F.lit(","), F.lit(2))), F.trim(F.split_part(n, F.lit(","), F.lit(1))))).otherwise(person(F.trim(F.regexp_extract(n, r"^(.*)\s\S+$", 1)), F.regexp_extract(n, r"(\S+)$", 1)))


def record(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    text = F.lit(None).cast("string")
    base = {"title": text, "authors": F.array().cast(PEOPLE), "journal": text, "publisher": text, "year": F.lit(None).cast("int"), "volume": text, "number": text, "pages": text, "type": text, "doi": text, "url": text, "arxiv_id": text, "issn": F.array().cast("array<string>"), "venue_key": text, "venue_source_id": text, "method": F.lit(source), "is_preprint_of": F.array().cast("array<string>"), "structured": F.lit(False), "order_reliable": F.lit(False)}
    cols = base | columns
    return df.select(F.lit(source).alias("source"), *[v.alias(k) for k, v in cols.items()])


def crossref(m: DataFrame) -> DataFrame:
    """Crossref messages. The year is the first date stated, `created` last; a subtitle is added if not in the title."""
    title, sub = untag(F.get("title", 0)), untag(F.get("subtitle", 0))
    full = F.when(none_if_empty(sub).isNotNull() & ~F.contains(F.lower(title), F.lower(sub)), F.concat_ws(": ", title, sub)).otherwise(title)
    date = lambda c: F.get(F.get(F.col(c)["date-parts"], 0), 0)
    year = F.coalesce(*[date(f"`{c}`") for c in ("published-print", "published-online", "issued", "published", "created")])
    who = F.transform("author", lambda a: person(a["given"], F.coalesce(a["family"], a["literal"])))
    of = F.transform(F.filter(F.coalesce(F.col("relation")["is-preprint-of"], F.array().cast("array<struct<`id-type`:string,id:string>>")), lambda r: r["id-type"] == "doi"), lambda r: r["id"])
    return record(m, "crossref", title=full, authors=F.coalesce(who, F.array().cast(PEOPLE)), journal=F.get(F.col("`container-title`"), 0), publisher=F.col("publisher"), year=year.cast("int"), volume=F.col("volume"), number=F.col("issue"), pages=F.col("page"), type=F.col("type"), doi=doi_normalize(F.col("DOI")), url=F.col("URL"), issn=F.filter(F.transform(F.coalesce("ISSN", F.array().cast("array<string>")), issn_normalize), lambda x: x.isNotNull()), is_preprint_of=of, structured=F.coalesce(F.exists("author", lambda a: F.coalesce(a["family"], F.lit("")) != ""), F.lit(False)), order_reliable=F.lit(True))


def dblp(hits: DataFrame, strict: bool = False) -> DataFrame:
    """DBLP hits. strict: for resolving, without mirrors of preprints and records without year or link."""
    i = lambda f: F.col(f"info.{f}")
    venue = F.coalesce(i("venue"), i("journal"))
    rows = hits.filter(~is_preprint_venue(venue) & i("year").isNotNull() & (i("doi").isNotNull() | i("ee").isNotNull())) if strict else hits
    kind = F.when(F.lower(i("type")).rlike("conference|workshop"), "proceedings-article").when(F.lower(i("type")).rlike("journal"), "journal-article").otherwise("other")
    return record(rows, "dblp", title=F.regexp_replace(untag(i("title")), r"\.$", ""), authors=F.coalesce(F.transform("info.authors.author", lambda a: flat_name(a["text"])), F.array().cast(PEOPLE)), journal=venue, year=i("year").try_cast("int"), volume=i("volume"), number=i("number"), pages=i("pages"), type=kind, doi=doi_normalize(i("doi")), url=i("ee"), venue_key=stream_key(i("key"), i("url")), order_reliable=F.lit(not strict))


def openalex(works: DataFrame, strict: bool = False) -> DataFrame:
    src, b = F.col("primary_location.source"), F.col("biblio")
    pages = F.when(b["first_page"] == b["last_page"], b["first_page"]).otherwise(F.concat_ws("-", b["first_page"], b["last_page"]))
    kind = F.when(F.col("type") == "article", "journal-article").otherwise(F.col("type"))
    return record(works, "openalex", title=untag(F.coalesce("title", "display_name")), authors=F.coalesce(F.transform("authorships", lambda a: flat_name(a["author"]["display_name"])), F.array().cast(PEOPLE)), journal=src["display_name"], publisher=src["host_organization_name"], year=F.col("publication_year").cast("int"), volume=b["volume"], number=b["issue"], pages=none_if_empty(pages), type=kind, doi=doi_normalize(F.col("doi")), url=F.col("primary_location.landing_page_url"), arxiv_id=arxiv_id(F.col("primary_location.landing_page_url")), issn=F.filter(F.transform(F.coalesce(src["issn"], F.array().cast("array<string>")), issn_normalize), lambda x: x.isNotNull()), venue_source_id=src["id"], order_reliable=F.lit(not strict))


def openreview(notes: DataFrame) -> DataFrame:
    """Notes (title, authors, authorids, venue, venueid, year). Names are structured where every author has a handle."""
    handles = F.coalesce(F.transform("authorids", tilde_family), F.array().cast("array<string>"))
    known = (F.size(handles) > 0) & (F.size(handles) == F.size("authors")) & F.forall(handles, lambda h: h.isNotNull())
    named = F.transform("authors", lambda a, i: F.when(known, person(F.regexp_replace(a, r"\s+\S+$", ""), F.get(handles, i))).otherwise(flat_name(a)))
    year = F.coalesce(F.col("year").try_cast("int"), F.regexp_extract(F.coalesce("venue", F.lit("")), r"\b((?:19|20)[0-9]{2})\b", 1).try_cast("int"))
    ok = acceptance(F.col("venue"), F.col("venueid"))
    return record(notes, "openreview", title=F.col("title"), authors=F.coalesce(named, F.array().cast(PEOPLE)), journal=F.col("venue"), year=year, type=F.when(ok == "accepted", "proceedings-article").when(ok == "preprint", "posted-content").otherwise("other"), url=F.concat(F.lit("https://openreview.net/forum?id="), F.coalesce("forum", "id")), structured=known, order_reliable=F.lit(True))


def semantic_scholar(papers: DataFrame) -> DataFrame:
    venue = F.coalesce(none_if_empty(F.col("publicationVenue.name")), none_if_empty(F.col("journal.name")), none_if_empty(F.col("venue")))
    kinds = F.coalesce("publicationTypes", F.array().cast("array<string>"))
    kind = F.when(F.array_contains(kinds, "JournalArticle"), "journal-article").when(F.array_contains(kinds, "Conference"), "proceedings-article").otherwise("other")
    return record(papers.filter(~is_preprint_venue(venue)), "s2", title=F.col("title"), authors=F.coalesce(F.transform("authors", lambda a: flat_name(a["name"])), F.array().cast(PEOPLE)), journal=venue, year=F.col("year").cast("int"), type=kind, doi=doi_normalize(F.col("externalIds.DOI")), url=F.col("url"), arxiv_id=F.col("externalIds.ArXiv"))


def arxiv_atom(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Atom entries as text; an entry that reports an error gives no record."""
    one = lambda path: F.get(F.xpath(xml, F.lit(path)), 0)
    local = lambda name: f"/*[local-name()='entry']/*[local-name()='{name}']/text()"
    rows = feeds.withColumn("_id", one(local("id"))).filter(~F.contains(F.coalesce("_id", F.lit("")), F.lit("/api/errors")))
    names = F.xpath(xml, F.lit("/*[local-name()='entry']/*[local-name()='author']/*[local-name()='name']/text()"))
    return record(rows, "arxiv", title=F.trim(F.regexp_replace(one(local("title")), r"\s+", " ")), authors=F.transform(names, flat_name), journal=F.lit("arXiv"), year=F.substring(one(local("published")), 1, 4).try_cast("int"), type=F.lit("preprint"), doi=doi_normalize(one(local("doi"))), url=F.col("_id"), arxiv_id=arxiv_id(F.col("_id")))


def europepmc(results: DataFrame) -> DataFrame:
    """Results that are no preprints; names are `Family AB`, the initials being short and upper-case."""

    def split(n: Column) -> Column:
        last = F.regexp_extract(n, r"(\S+)$", 1)
        initials = (F.length(last) <= 3) & (F.upper(last) == last) & F.contains(n, F.lit(" "))
        return F.when(initials, person(last, F.regexp_replace(n, r"\s+\S+$", ""))).otherwise(flat_name(n))

    names = F.array_remove(F.transform(F.split(F.regexp_replace(F.coalesce("authorString", F.lit("")), r"\.$", ""), ", "), lambda x: F.trim(x)), "")
    rows = results.filter(F.coalesce("source", F.lit("")) != "PPR")
    return record(rows, "europepmc", title=F.regexp_replace("title", r"\.$", ""), authors=F.transform(names, split), journal=F.col("journalTitle"), year=F.col("pubYear").try_cast("int"), volume=F.col("journalVolume"), number=F.col("issue"), pages=F.col("pageInfo"), type=F.lit("journal-article"), doi=doi_normalize(F.col("doi")))


def anthology(entries: DataFrame) -> DataFrame:
    """Entries of an anthology's bibliography."""
    names = F.transform(F.filter(F.split(F.coalesce("author", F.lit("")), r"\s+and\s+"), lambda x: x != ""), flat_name)
    return record(entries, "acl", title=F.regexp_replace("title", "[{}]", ""), authors=names, journal=F.coalesce("booktitle", "journal"), publisher=F.col("publisher"), year=F.col("year").try_cast("int"), pages=F.col("pages"), type=F.when(F.col("entry_type") == "article", "journal-article").otherwise("proceedings-article"), doi=doi_normalize(F.col("doi")), url=F.col("url"))


def scholar(pubs: DataFrame) -> DataFrame:
    b = lambda f: F.col(f"bib.{f}")
    names = F.transform(F.filter(F.split(F.coalesce(b("author"), F.lit("")), r"\s+and\s+"), lambda x: x != ""), flat_name)
    conference = F.lower(F.coalesce(b("ENTRYTYPE"), F.lit(""))).isin("inproceedings", "conference")
    return record(pubs, "scholar", title=b("title"), authors=names, journal=F.coalesce(b("journal"), b("booktitle"), b("venue")), year=b("pub_year").try_cast("int"), volume=b("volume"), number=b("number"), pages=b("pages"), type=F.when(conference, "proceedings-article").otherwise("journal-article"), url=F.coalesce("pub_url", "eprint_url"), method=F.when(F.coalesce("_partial", F.lit(False)), "GoogleScholar(search,partial)").otherwise("GoogleScholar(search)"))


CONVERTERS = {"crossref": crossref, "dblp": dblp, "openalex": openalex, "openreview": openreview, "s2": semantic_scholar, "arxiv": arxiv_atom, "europepmc": europepmc, "acl": anthology, "scholar": scholar}


def snapshot(**sources: DataFrame) -> DataFrame:
    """Records of several sources with record_id and ingest_ord: by source, then title, DOI and place in that order."""
    out = None
    for name, df in sources.items():
        out = CONVERTERS[name](df) if out is None else out.unionByName(CONVERTERS[name](df))
    key = F.xxhash64("source", "title", "doi", "url", "year", "journal")
    return out.withColumn("ingest_ord", key).withColumn("record_id", F.concat_ws(":", "source", F.hex(key)))
