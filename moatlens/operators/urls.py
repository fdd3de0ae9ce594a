"""URL resolution over landed fetch results: sitemaps, probes, job boards, domains."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moatlens.functions import lexicons as L
from moatlens.functions import text as T
from moatlens.session import ensure_checkpoint_dir

# XML character entities decoded in <loc> text (fixed values).
_XML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]


def _numeric_entities(c: Column) -> Column:
    """``&#38;`` and ``&#x26;`` decoded: the pieces after each ``&#`` are a number, ``;`` and the rest."""
    pieces = F.split(c, "&#(?=(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});)", -1)

    def decoded(p: Column, i: Column) -> Column:
        code = F.substring_index(p, ";", 1)
        number = F.when(F.lower(F.substring(code, 1, 1)) == "x", F.conv(F.substring(code, 2, 9), 16, 10)).otherwise(code).cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")  # a code point, through its UTF-32 bytes
        return F.when(i == 0, p).otherwise(F.concat(char, F.substr(p, F.length(code) + 2)))

    return F.when(F.contains(c, F.lit("&#")), F.array_join(F.transform(pieces, decoded), "")).otherwise(c)


def xml_unescape(c: Column) -> Column:
    c = _numeric_entities(c)
    for ent, ch in _XML_ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


#: What may stand before and behind a document's root: white space and processing instructions.
_AROUND = r"(?:\s++|<\?.*?\?>)*+"
_CDATA = r"<!\[CDATA\["


def _bare(body: Column) -> Column:
    """The body without comments; a comment that doesn't end takes the text up to the next one with it."""
    behind = lambda p: F.when(F.contains(p, F.lit("-->")), F.substr(p, F.locate("-->", p) + 3)).otherwise("")
    pieces = F.split(body, "<!--", -1)
    return F.when(F.contains(body, F.lit("<!--")), F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(behind(p))), "")).otherwise(body)


def _root(bare: Column) -> Column:
    """Name of the root element, sitemap or index, if the text begins with its opening and ends with its closing tag."""
    name = F.regexp_extract(bare, rf"(?s)\A{_AROUND}<(urlset|sitemapindex)[\s/>]", 1)
    last = F.substring_index(bare, "</", -1)
    closed = F.regexp_extract(last, rf"(?s)\A(urlset|sitemapindex)\s*+>{_AROUND}\z", 1)
    return F.when((name != "") & (name == closed), name)


def _usual() -> str:
    """Pattern of the documents that sitemaps usually are, all of them well-formed.

    A root with entries of a few text elements, comments and character data
    anywhere, a default namespace and an XML declaration. Every loop is
    possessive: no character is looked at twice.
    """
    misc = r"(?:\s++|<!--(?:[^-]++|-(?!-))*+-->)*+"
    char = r"[^<>&\x00-\x08\x0B\x0C\x0E-\x1F]++"
    text = rf"(?:{char}|&(?:lt|gt|quot|apos|amp|#(?!0)[0-9]{{2,4}}|#x[2-9a-fA-F][0-9a-fA-F]{{1,3}});|<!\[CDATA\[(?:[^\]<>&\x00-\x1F]|&)*+\]\]>|<!--(?:[^-]++|-(?!-))*+-->)*+"
    declaration = r"""(?:<\?xml\s++version\s*+=\s*+(?:"1\.0"|'1\.0')(?:\s++encoding\s*+=\s*+(?:"[A-Za-z][\w.-]*+"|'[A-Za-z][\w.-]*+'))?+\s*+\?>)?+"""
    space = r"""(?:\s++xmlns\s*+=\s*+(?:"[^"<&]++"|'[^'<&]++'))?+"""
    leaf = rf"<(loc|lastmod|changefreq|priority)>{text}</\3>{misc}"
    entry = rf"<(url|sitemap)>{misc}(?:{leaf})*+</\2>{misc}"
    return rf"\A{declaration}{misc}<(urlset|sitemapindex){space}\s*+>{misc}(?:{entry})*+</\1\s*+>{misc}\z"


def _well_formed(body: Column) -> Column:
    """Whether a sitemap or sitemap index is a well-formed document.

    Usual documents are known by one linear pattern. For all others Spark's
    streaming XML reader checks tags, entities, attributes and comments of the
    text within one element around it; it stands for the whole text, so what
    follows the root counts too. Prefixes must be declared somewhere in the
    document. A document type declaration is not accepted.
    """
    whole = F.concat(F.lit("<document>"), F.regexp_replace(body, r"(?s)\A<\?xml\s.*?\?>", ""), F.lit("</document>"))
    parsed = F.from_xml(whole, "urlset array<string>, sitemapindex array<string>, _bad string",
                        {"rowTag": "document", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    n = lambda roots: F.coalesce(F.size(roots), F.lit(0))
    read = T.let(parsed, lambda p: F.coalesce(p["_bad"].isNull() & (n(p["urlset"]) + n(p["sitemapindex"]) == 1), F.lit(False)))

    def declared(bare: Column) -> Column:
        used = F.array_distinct(F.regexp_extract_all(bare, F.lit(r"<([A-Za-z_][\w.-]*):"), F.lit(1)))
        return F.forall(used, lambda p: F.contains(bare, F.concat(F.lit("xmlns:"), p, F.lit("="))))
    # the cheap tests first: most bodies of failed fetches are no XML at all
    return F.when(body.rlike(_usual()), F.lit(True)).when(T.let(_bare(body), lambda bare: _root(bare).isNotNull() & declared(bare)), read).otherwise(F.lit(False))


def _locs(body: Column) -> Column:
    """Trimmed, decoded <loc> texts in document order (empty elements skipped).

    An element's text ends at its first child element. Comments are no
    elements; CDATA sections are taken as they stand.
    """
    bare = _bare(body)
    raw = F.regexp_extract_all(bare, F.lit(rf"(?s)<loc(?:\s[^<>]*)?(?<!/)>((?:[^<]++|{_CDATA}.*?\]\]>)*+)"), F.lit(1))
    pieces = lambda x: F.regexp_extract_all(x, F.lit(rf"(?s)([^<]++|{_CDATA}.*?\]\]>)"), F.lit(1))
    inner = lambda x: F.substring(x, 10, F.length(x) - 12)
    text = lambda x: F.when(F.contains(x, F.lit("<![CDATA[")), F.array_join(F.transform(pieces(x), lambda p: F.when(
        F.startswith(p, F.lit("<![CDATA[")), inner(p)).otherwise(xml_unescape(p))), "")).otherwise(xml_unescape(x))
    return F.filter(F.transform(raw, lambda x: T.strip(text(x))), lambda x: x != "")


def _written(rows: DataFrame) -> DataFrame:
    path = f"{ensure_checkpoint_dir(rows.sparkSession)}/moatlens-sitemaps-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _parsed(sitemaps: DataFrame) -> DataFrame:
    """(domain, url, is_index, at_root, locs) of every well-formed document, parsed once and written; one row per domain and URL."""
    body = F.col("body")
    is_index = _root(_bare(body)) == "sitemapindex"
    at_root = F.col("url") == F.concat(F.lit("https://"), F.col("domain"), F.lit("/sitemap.xml"))
    docs = sitemaps.filter(_well_formed(body)).select("domain", "url", is_index.alias("is_index"), at_root.alias("at_root"), _locs(body).alias("locs"))
    docs = _written(docs)
    again = docs.groupBy("domain", "url").count().filter("count > 1").select("domain", "url")
    if again.isEmpty():
        return docs
    # a document fetched more than once: the last of its well-formed bodies in the order of their hashes
    one = Window.partitionBy("domain", "url").orderBy(F.xxhash64("is_index", "locs").desc())
    repeated = docs.join(again, ["domain", "url"], "left_semi").withColumn("_rn", F.row_number().over(one)).filter(F.col("_rn") == 1).drop("_rn")
    return _written(docs.join(again, ["domain", "url"], "left_anti").unionByName(repeated))


def sitemap_locs(sitemaps: DataFrame, children: int | None = None, nested: bool = True) -> DataFrame:
    """All <loc> URLs per domain; an index sitemap contributes its child sitemaps (the first ``children``, or all).

    ``sitemaps(domain, url, body)`` holds the sitemap documents fetched for a
    domain; its root sitemap is ``https://<domain>/sitemap.xml``. Documents
    that are not well-formed give nothing. ``child`` is 0 for the root's own
    URLs and else the child's place in the root's index, so the URLs of an
    index's first three children are those with child <= 3. ``sitemap_url`` is
    the document a URL stands in and ``pos`` its place there.

    Indexes within indexes are followed by one join per level, until none is
    new (not at all without ``nested``); a document that a domain reaches on
    several ways counts for the first child that leads to it.
    """
    docs = _parsed(sitemaps)
    listed = F.col("locs") if children is None else F.slice("locs", 1, children)
    out = docs.filter(F.col("at_root") & ~F.col("is_index")).select("domain", F.lit(0).alias("child"), "url", "locs")
    to = docs.filter(F.col("at_root") & F.col("is_index")).select("domain", F.posexplode(listed).alias("child", "url"))
    to = to.groupBy("domain", "url").agg((F.min("child") + 1).alias("child"))
    inner = docs.filter(F.col("is_index") & ~F.col("at_root"))
    if nested and not inner.isEmpty():
        state = None
        while True:
            more = inner.select("domain", "url", "locs").join(to, ["domain", "url"]).select("domain", "child", F.explode("locs").alias("url"))
            to = _written(to.unionByName(more).groupBy("domain", "url").agg(F.min("child").alias("child")))
            before, state = state, to.agg(F.count("*"), F.sum("child")).first()
            if before == state:
                break
    out = out.unionByName(docs.filter(~F.col("is_index") & ~F.col("at_root")).join(to, ["domain", "url"]).select("domain", "child", "url", "locs"))
    out = out.select("domain", "child", F.col("url").alias("sitemap_url"), T.explode_kept(F.col("locs"), pos=True).alias("pos", "loc"))
    return out.filter(F.col("loc").isNotNull())


def url_path(url: Column) -> Column:
    """Text after the host (the host itself when the URL has no '/' after it)."""
    after = F.element_at(F.split(url, "://", 2), -1)
    return F.when(F.contains(url, F.lit("/")), F.element_at(F.split(after, "/", 2), -1)).otherwise(F.lit(""))


def sitemap_candidates(locs: DataFrame, keywords=L.DISCOVERY_KEYWORDS) -> DataFrame:
    """(domain, feature, a, b, url) of the URLs with a keyword: a is its place in the list, b the length of the path."""
    feats = F.array(*[F.struct(F.lit(f).alias("feature"), T.lit_array(kws).alias("kws")) for f, kws in keywords])
    x = locs.select("domain", "loc", F.explode(feats).alias("f"))
    idx = T.first(F.filter(F.transform(F.col("f.kws"), lambda k, i: F.when(F.contains(F.lower("loc"), k), i)),
                           lambda i: i.isNotNull()))
    return x.select("domain", F.col("f.feature").alias("feature"), idx.alias("a"),
                    F.length(url_path(F.col("loc"))).alias("b"), F.col("loc").alias("url")).filter(F.col("a").isNotNull())


def pick_url(locs: DataFrame, keywords=L.DISCOVERY_KEYWORDS) -> DataFrame:
    """Best URL per (domain, feature): lowest keyword index, then shortest path, then text."""
    best = sitemap_candidates(locs, keywords).groupBy("domain", "feature").agg(F.min(F.struct("a", "b", "url")).alias("c"))
    return best.select("domain", "feature", F.col("c.url").alias("url"))


def probe_candidates(probes: DataFrame, paths=L.FALLBACK_PATHS, min_chars: int = L.PROBE_MIN_CHARS) -> DataFrame:
    """(domain, feature, a, b, url) of the probes that succeeded with enough content: a is the place of the path.

    ``probes(domain, path, success, n_chars)`` is the fetch log of the probes;
    the few fallback paths are literals, so nothing is joined.
    """
    cand = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(p).alias("path"), F.lit(i).alias("a"))
                     for f, ps in paths for i, p in enumerate(ps)])
    ok = probes.filter(F.coalesce(F.col("success"), F.lit(False)) & (F.col("n_chars") >= min_chars))
    hit = ok.select("domain", "path", T.explode_kept(F.filter(cand, lambda c: c["path"] == F.col("path"))).alias("c")).filter(F.col("c").isNotNull())
    return hit.select("domain", F.col("c.feature").alias("feature"), F.col("c.a").alias("a"), F.lit(0).alias("b"),
                      F.concat(F.lit("https://"), F.col("domain"), F.col("path")).alias("url"))


def probe_pick(probes: DataFrame, paths=L.FALLBACK_PATHS, min_chars: int = L.PROBE_MIN_CHARS) -> DataFrame:
    """First fallback path (priority order) whose probe succeeded with enough content."""
    best = probe_candidates(probes, paths, min_chars).groupBy("domain", "feature").agg(F.min_by("url", "a").alias("url"))
    return best.select("domain", "feature", "url")


def company_slug(name: Column) -> Column:
    s = F.replace(F.replace(F.lower(name), F.lit("_"), F.lit("-")), F.lit(" "), F.lit("-"))
    return F.regexp_replace(s, r"[^a-z0-9\-]", "")


def ats_candidates(companies: DataFrame, name_col: str = "company") -> DataFrame:
    """Four job-board URLs per company slug, in priority order; none for an empty slug."""
    slug = company_slug(F.col(name_col))
    urls = F.array(*[F.struct(F.lit(i).alias("board_no"),
                              F.concat(*[slug if p is None else F.lit(p) for p in _split_template(t)]).alias("url"))
                     for i, t in enumerate(L.ATS_TEMPLATES)])
    return companies.select(name_col, slug.alias("slug")).filter(F.col("slug") != "") \
        .select(name_col, "slug", F.explode(urls).alias("u")).select(name_col, "slug", "u.board_no", "u.url")


def _split_template(t: str):
    pre, post = t.split("{slug}")
    return [pre, None, post]


def ats_pick(candidates: DataFrame, fetch_log: DataFrame, name_col: str = "company",
             min_chars: int = L.ATS_MIN_CHARS) -> DataFrame:
    ok = fetch_log.filter(F.coalesce(F.col("success"), F.lit(False)) & (F.col("n_chars") >= min_chars)).select("url")
    hit = candidates.join(ok, "url", "left_semi")
    return hit.groupBy(name_col).agg(F.min_by("url", "board_no").alias("url"))


def reachable(success: Column, error: Column) -> Column:
    """A fetch shows the domain alive unless it failed with a timeout/connection error."""
    e = F.lower(F.coalesce(error, F.lit("")))
    dead = F.lit(False)
    for m in L.DEAD_DOMAIN_MARKERS:
        dead = dead | F.contains(e, F.lit(m))
    return F.coalesce(success, F.lit(False)) | ~dead


def domain_reachability(fetch_log: DataFrame) -> DataFrame:
    return fetch_log.groupBy("domain").agg(F.bool_or(reachable(F.col("success"), F.col("error_message"))).alias("reachable"))


def review_url(review_id: Column, review_slug: Column) -> Column:
    """The review page of a company whose id and slug are known."""
    return F.when((F.coalesce(review_id, F.lit("")) != "") & (F.coalesce(review_slug, F.lit("")) != ""),
                  F.concat(F.lit(L.REVIEW_URL_PREFIX), review_id, F.lit("/"), review_slug, F.lit("/reviews/")))


def resolve_urls(domains: DataFrame, locs: DataFrame, probes: DataFrame, ats: DataFrame | None = None) -> DataFrame:
    """Sitemap pick, else probe pick, else (signals only) job board; homepage always; review page where known.

    ``domains(domain, company[, review_id, review_slug])``; unreachable domains
    keep only the homepage and the review page, which isn't theirs. All
    candidates and the probes' signs of life are rows of one table and one
    aggregate on the domain picks among them.
    """
    none = lambda t: F.lit(None).cast(t)
    cols = ["domain", "feature", "rank", "a", "b", "url", "alive"]
    rows = sitemap_candidates(locs).withColumn("rank", F.lit(0)).withColumn("alive", none("boolean")).select(cols)
    rows = rows.unionByName(probe_candidates(probes).withColumn("rank", F.lit(1)).withColumn("alive", none("boolean")).select(cols))
    rows = rows.unionByName(probes.select("domain", none("string").alias("feature"), none("int").alias("rank"), none("int").alias("a"), none("int").alias("b"),
                                          none("string").alias("url"), reachable(F.col("success"), F.col("error_message")).alias("alive")))
    if ats is not None:
        jobs = ats.select("company", "url").join(domains.select("company", "domain"), "company")
        rows = rows.unionByName(jobs.select("domain", F.lit("signals").alias("feature"), F.lit(2).alias("rank"), F.lit(0).alias("a"), F.lit(0).alias("b"),
                                            "url", none("boolean").alias("alive")))
    pick = lambda f: F.min(F.when(F.col("feature") == f, F.struct("rank", "a", "b", "url"))).alias(f)
    best = rows.groupBy("domain").agg(pick("pricing"), pick("signals"), F.bool_or("alive").alias("_alive"))
    d = domains.join(best, "domain", "left")
    alive = F.coalesce("_alive", F.lit(True))
    source = lambda f: F.when(alive, F.get(F.array(*[F.lit(x) for x in ("sitemap", "probe", "ats")]), F.col(f"{f}.rank")))
    known = "review_id" in domains.columns and "review_slug" in domains.columns
    return d.select(
        "domain", "company", alive.alias("reachable"),
        F.when(alive, F.col("pricing.url")).alias("pricing_url"), source("pricing").alias("pricing_source"),
        F.concat(F.lit("https://"), F.col("domain")).alias("messaging_url"),
        F.when(alive, F.col("signals.url")).alias("signals_url"), source("signals").alias("signals_source"),
        (review_url(F.col("review_id"), F.col("review_slug")) if known else none("string")).alias("complaints_url"))


def domain_normalize(raw: Column) -> Column:
    d = F.lower(T.strip(raw))
    d = F.regexp_replace(d, "^https?://", "")
    d = F.regexp_replace(d, r"^www\.", "")
    return F.regexp_replace(d, "/+$", "")


def domain_valid(domain: Column) -> Column:
    return domain.rlike(L.DOMAIN_PATTERN)


def company_key(raw: Column) -> Column:
    return F.regexp_replace(F.lower(T.strip(raw)), T.rx(r"\s+"), "-")


def positions(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Number the rows from 0 in the given order, without bringing them together in one task.

    Rows are range-partitioned, sorted within partitions and written; the rows
    of all partitions before come as an offset from a table of a row per
    partition. Ties are numbered in some order.
    """
    spark = rows.sparkSession
    n = spark.sparkContext.defaultParallelism
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    path = f"{ensure_checkpoint_dir(spark)}/moatlens-positions-{uuid.uuid4().hex}"
    ranged.select("*", F.spark_partition_id().alias("_part"), inside.alias("_at")).write.parquet(path)
    placed = spark.read.parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    return placed.join(offsets, "_part").select(*rows.columns, (F.col("_offset") + F.col("_at")).alias(name))


def registry_merge(builtin: DataFrame, saved: DataFrame, cols=("company", "domain", "review_id", "review_slug"), order: str | None = None) -> DataFrame:
    """Built-in entries, then saved entries whose full tuple is not built in (nulls compare equal).

    With ``order``, a column of both that numbers their entries, the result
    gets ``position``: its place in the merged list, from 0.
    """
    keep = [*cols, *([order] if order else [])]
    cond = [saved[c].eqNullSafe(builtin[c]) for c in cols]
    extra = saved.join(builtin.select(*cols), cond, "left_anti")
    out = builtin.select(*keep, F.lit("builtin").alias("origin")).unionByName(extra.select(*keep, F.lit("saved").alias("origin")))
    return positions(out, ["origin", order]).drop(order) if order else out  # builtin sorts before saved


def registry_upsert(existing: DataFrame, new: DataFrame, order_col: str,
                    cols=("company", "domain", "review_id", "review_slug")) -> DataFrame:
    """Add new entries unless an entry with the same (company, domain) exists.

    Of new entries with the same pair the first by ``order_col`` wins, then the
    smallest by the other columns, so the winner doesn't depend on the run.
    """
    rest = [c for c in cols if c not in ("company", "domain")]
    first = new.groupBy("company", "domain").agg(F.min(F.struct(order_col, *[F.col(c).alias(f"_{c}") for c in rest])).alias("_f"))
    batch = first.select("company", "domain", *[F.col(f"_f._{c}").alias(c) for c in rest])
    add = batch.join(existing.select("company", "domain"), ["company", "domain"], "left_anti")
    return existing.select(*cols).unionByName(add.select(*cols))
