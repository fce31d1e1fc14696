"""Text cleaning, step by step and whole."""

from pyspark.sql import functions as F

from contract import sqltext as Q
from contract.views import query
from murmurate.functions import text as X
from murmurate.functions.emoji import country_names, demojize
from murmurate.plans.prepare import clean_posts


def _step(name: str, sql: str, column) -> None:
    @query(name, "posts", f"SELECT id_str, {sql} AS text FROM posts")
    def step(v):
        return v.posts.select("id_str", column(F.col("full_text")).alias("text"))


_step("tx_lower", "lower(full_text)", X.lower)
_step("tx_url", Q.url("lower(full_text)"), lambda c: X.mask_urls(X.lower(c)))
_step("tx_mention", Q.mention("full_text"), X.mask_mentions)
_step("tx_entity", Q.entity("full_text"), X.drop_entities)
_step("tx_newline", Q.newline("full_text"), X.join_lines)
_step("tx_space", Q.space("full_text"), X.squeeze_spaces)
_step(
    "harvest_space",
    Q.harvest_space("full_text"),
    X.squeeze_harvested,
)


@query("tx_non_string", "posts", "SELECT id_str, coalesce(location, '') AS text FROM posts")
def tx_non_string(v):
    return v.posts.select("id_str", X.text_or_empty(F.col("location")).alias("text"))


@query("tx_emoji", "posts", f"SELECT id_str, {Q.emoji('full_text')} AS text FROM posts")
def tx_emoji(v):
    return v.posts.select(
        "id_str", demojize(F.col("full_text"), country_names(v.spark)).alias("text")
    )


@query("clean_text", "posts", f"""
    SELECT id_str, lang, {Q.cleaned('full_text')} AS clean_text FROM posts
    WHERE lang IN ('in', 'id')""")
def clean_text(v):
    return clean_posts(v.posts, emoji_names=country_names(v.spark)).select(
        "id_str", "lang", "clean_text"
    )


@query("clean_pages", "pages", f"SELECT page_id, {Q.cleaned('html')} AS clean_text FROM pages")
def clean_pages(v):
    pages = X.with_clean_text(v.pages, "html", "clean_text", country_names(v.spark))
    return pages.select("page_id", "clean_text")
