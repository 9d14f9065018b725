"""Pull requests from forges, as JSON that a collector has landed, and advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.plans.loops import numbered

# Page size of each forge's list of open pull requests.
PAGE_SIZES = {"github": 100, "gitlab": 100, "bitbucket": 50, "gitea": 50}

_USER = "struct<login:string,username:string,display_name:string,nickname:string>"
_SCHEMAS = {
    "github": f"id long, number long, title string, user {_USER}, head struct<ref:string,sha:string>, base struct<ref:string>, updated_at string, html_url string",
    "gitea": f"id long, number long, title string, user {_USER}, head struct<ref:string,sha:string>, base struct<ref:string>, updated_at string, html_url string",
    "gitlab": f"id long, iid long, title string, author {_USER}, source_branch string, target_branch string, sha string, updated_at string, web_url string",
    "bitbucket": f"id long, title string, author {_USER}, source struct<branch:struct<name:string>,commit:struct<hash:string>>, destination struct<branch:struct<name:string>>, updated_on string",
}


def request_url(forge: str, api: str, slug: str) -> str:
    """The list request: open, newest update first, one page."""
    n = PAGE_SIZES[forge]
    if forge == "gitlab":
        return f"{api}/projects/{slug.replace('/', '%2F')}/merge_requests?state=opened&order_by=updated_at&sort=desc&per_page={n}"
    if forge == "bitbucket":
        return f"{api}/repositories/{slug}/pullrequests?state=OPEN&sort=-updated_on&pagelen={n}"
    return f"{api}/repos/{slug}/pulls?state=open&sort={'updated&direction=desc' if forge == 'github' else 'recentupdate'}&{'per_page' if forge == 'github' else 'limit'}={n}"


def pull_requests(raw: DataFrame, forge: str) -> DataFrame:
    """(repo, id, number, title, author, head, base, head_sha, updated_at) of raw(repo, value): one answer a row.

    Works on static and streaming tables alike; an answer that is no JSON list gives no rows.
    """
    inner = f"array<struct<{_SCHEMAS[forge].replace(' struct<', ':struct<').replace(' string', ':string').replace(' long', ':long')}>>"
    value = F.get_json_object("value", "$.values") if forge == "bitbucket" else F.col("value")
    p = raw.select("repo", F.explode(F.from_json(value, inner)).alias("p")).where("p.id is not null")  # an error message parses as a list of nothing
    who = lambda u: F.coalesce(F.col(f"p.{u}.login"), F.col(f"p.{u}.username"), F.col(f"p.{u}.nickname"), F.col(f"p.{u}.display_name"))
    time = lambda c: F.try_to_timestamp(F.col(c))
    if forge == "gitlab":
        columns = (F.col("p.iid"), who("author"), F.col("p.source_branch"), F.col("p.target_branch"), F.col("p.sha"), time("p.updated_at"))
    elif forge == "bitbucket":
        columns = (F.col("p.id"), who("author"), F.col("p.source.branch.name"), F.col("p.destination.branch.name"), F.col("p.source.commit.hash"), time("p.updated_on"))
    else:
        columns = (F.col("p.number"), who("user"), F.col("p.head.ref"), F.col("p.base.ref"), F.col("p.head.sha"), time("p.updated_at"))
    number, author, head, base, sha, updated = columns
    return p.select("repo", F.col("p.id").alias("id"), number.alias("number"), F.col("p.title").alias("title"), author.alias("author"), head.alias("head"), base.alias("base"), sha.alias("head_sha"), updated.alias("updated_at"))


def advisories(spark: SparkSession, path: str) -> DataFrame:
    """(ecosystem, name, version, id, summary, aliases, severity, db_severity) of advisory JSON, one a line."""
    schema = "id string, summary string, details string, aliases array<string>, severity array<struct<type:string,score:string>>, database_specific struct<severity:string>, affected array<struct<package:struct<ecosystem:string,name:string>,versions:array<string>>>"
    raw = spark.read.schema(schema).json(path)
    each = raw.withColumn("a", F.explode("affected")).withColumn("version", F.explode("a.versions"))
    return each.select(F.col("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("name"), "version", "id", F.coalesce("summary", F.substring_index("details", "\n", 1)).alias("summary"), "aliases", "severity", F.col("database_specific.severity").alias("db_severity"))


def with_details(stubs: DataFrame, details: DataFrame) -> DataFrame:
    """Stubs(id, ...) with what details has of them; a stub without details stays as it is."""
    extra = [c for c in details.columns if c != "id"]
    d = details.dropDuplicates(["id"]).select("id", *[F.col(c).alias(f"_{c}") for c in extra])
    joined = stubs.join(d, "id", "left")
    return joined.select("id", *[F.coalesce(f"_{c}", F.col(c)).alias(c) if c in stubs.columns else F.col(f"_{c}").alias(c) for c in dict.fromkeys([*[c for c in stubs.columns if c != "id"], *extra]) if c in extra], *[c for c in stubs.columns if c not in extra and c != "id"])


def query_batches(deps: DataFrame, size: int = 1_000) -> DataFrame:
    """Distinct (ecosystem, name, version) with the `batch` of at most `size` that asks for them.

    The keys are numbered in order, by ranges, so no batch is larger.
    """
    keys = deps.select("ecosystem", "name", "version").distinct().withColumn("_key", F.struct("ecosystem", "name", "version"))
    return numbered(keys, "_key", "_n").select("ecosystem", "name", "version", F.floor(F.col("_n") / size).alias("batch"))
