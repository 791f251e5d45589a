"""Schemas of page snapshots and of the records in them."""

from __future__ import annotations

SEO = "struct<title:string,description:string,h1:string,word_count:int,article_word_count:int,excerpt:string>"
LINK = "struct<href:string,anchor:string,rel:string>"
LINKS = f"struct<internal:array<{LINK}>,external:array<{LINK}>>"
HEADINGS = (
    "struct<headings:array<struct<level:int,text:string>>,counts:struct<h1:int,h2:int,h3:int,h4:int,h5:int,h6:int>,"
    "issues:struct<missing_h1:boolean,multiple_h1:boolean,h1_not_first:boolean,skipped_levels:boolean>>"
)
META = (
    "struct<canonical:string,robots:struct<noindex:boolean,nofollow:boolean,noarchive:boolean,nosnippet:boolean,raw:string>,"
    "open_graph:struct<title:string,description:string,image:string,url:string,type:string,siteName:string,extra:map<string,string>>,"
    "twitter_card:struct<card:string,title:string,description:string,image:string,site:string,creator:string,extra:map<string,string>>,"
    "hreflang:array<struct<hreflang:string,href:string>>,viewport:string>"
)
IMAGES = (
    "struct<images:array<struct<src:string,alt_status:string,alt:string,width:int,height:int,loading:string,from_srcset:boolean>>,"
    "counts:struct<total:int,missing:int,decorative:int,present:int,lazy_loaded:int>>"
)
SCHEMA = "struct<blocks:array<struct<types:array<string>,raw:string>>,types:array<string>,has_schema:boolean>"
RECORDS = {"seo": SEO, "links": LINKS, "headings": HEADINGS, "meta": META, "images": IMAGES, "schema": SCHEMA}
CLIENT = {
    "seo": SEO[:-1] + ",canonical:string,robots:string>", "links": LINKS, "headings": HEADINGS,
    "schema": "array<struct<type:string,raw:string>>", "open_graph": "map<string,string>",
}
ARTICLE = "struct<title:string,byline:string,published_time:string,site_name:string,excerpt:string,length:int,truncated:boolean,content:string,notes:array<string>>"
#: Columns of a snapshot besides its records.
SNAPSHOT = "ord bigint, url string, status_code int, depth int, is_duplicate boolean"
SITEMAP = "struct<url:string,lastmod:string,changefreq:string,priority:double>"
DISCOVERY = "struct<url:string,title:string,snippet:string,date:string,type:string,position:int>"
