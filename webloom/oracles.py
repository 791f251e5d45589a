"""DuckDB SQL for the queries of the catalog; the page markup there is plain enough for patterns."""

from __future__ import annotations

_PAGES = r"""
with snap as (
  select page_id as ord, url, html, case when page_id % 50 = 49 then 503 when page_id % 20 = 19 then 404 else 200 end as status_code,
    (page_id % 4)::int as depth, page_id % 25 = 24 as is_duplicate from pages
), parts as (
  select *, trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's')) as t0, trim(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')) as h0,
    regexp_replace(regexp_replace(regexp_extract(html, '<body>(.*)', 1, 's'), '<nav>.*?</nav>|<footer>.*?</footer>|<!--.*?-->', '', 'gs'), '<[^>]+>', '', 'g') as body,
    regexp_extract(html, '<article>(.*?)</article>', 1, 's') as art
  from snap
), texts as (
  select *, replace(replace(replace(replace(replace(t0, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') as title,
    replace(replace(replace(replace(replace(h0, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') as h1,
    len(regexp_extract_all(body, '\S+'))::int as word_count,
    case when len(list_filter(string_split_regex(regexp_replace(art, '</?b>', '', 'g'), '</?p>')[2:], lambda x: length(trim(regexp_replace(x, '<[^>]+>', '', 'g'), E' \n\t')) >= 25)) > 0
      then len(regexp_extract_all(regexp_replace(regexp_replace(art, '</?b>', '', 'g'), '<[^>]+>', ' ', 'g'), '\S+')) else 0 end::int as article_word_count
  from parts
), flagged as (
  select *, '' as description, array_to_string(list_filter([
    case when status_code >= 500 then 'ERR_5XX' when status_code >= 400 then 'ERR_4XX' end, case when is_duplicate then 'WARN_DUPLICATE' end,
    case when h1 = '' then 'ERR_MISSING_H1' end, 'ERR_MISSING_DESC', case when article_word_count < 150 then 'WARN_THIN_CONTENT' end,
    case when length(title) > 60 then 'WARN_TITLE_TOO_LONG' when length(title) between 1 and 29 then 'WARN_TITLE_TOO_SHORT' end], lambda f: f is not null), ',') as flags
  from texts
), hrefs as (
  select ord, url, regexp_extract(url, '^https?://[^/?#]+') as origin, regexp_extract_all(html, '<a href="([^"]*)">', 1) as raw, regexp_extract_all(html, '<a href="[^"]*">(.*?)</a>', 1) as names from snap
), encoded as (
  select ord, url, list_transform(raw, lambda x: origin || replace(replace(url_encode(x), '%2F', '/'), '%2C', ',')) as found, names from hrefs
), single as (
  select ord, url, i - 1 as nth, found[i] as href, names[i] as anchor from (select *, unnest(range(1, len(found) + 1)) as i from encoded) where list_position(found, found[i]) = i
), links as (
  select ord, url, (row_number() over (partition by ord order by nth) - 1)::int as pos, href, anchor from single
), keyed as (
  select *, regexp_replace(regexp_replace(url, '#.*$', ''), '([^/])/(\?|$)', '\1\2') as key from snap
)
"""
_KEY = r"regexp_replace(regexp_replace({c}, '#.*$', ''), '([^/])/(\?|$)', '\1\2')"
_FLAGS = "['ERR_4XX','ERR_5XX','ERR_MISSING_DESC','ERR_MISSING_H1','WARN_DESC_TOO_LONG','WARN_DESC_TOO_SHORT','WARN_DUPLICATE','WARN_THIN_CONTENT','WARN_TITLE_TOO_LONG','WARN_TITLE_TOO_SHORT']"
_GRAPH = """
with links as (
  select source, target from (select l_partkey as source, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as target from lineitem) where target is not null
), edges as (
  select * from links where target in (select p_partkey from part)
), nodes as (
  select p_partkey as key, coalesce(i.n, 0)::bigint as in_links, coalesce(o.n, 0)::bigint as out_links from part
  left join (select target, count(*) as n from edges group by target) i on i.target = p_partkey
  left join (select source, count(*) as n from edges group by source) o on o.source = p_partkey
)
"""
_GAPS = _PAGES + rf""", captured as (
  select *, row_number() over (partition by key order by ord desc) as r from keyed where not is_duplicate
), listed as (
  select *, row_number() over (partition by key order by ord desc) as r from (
    select ord, u as url, {_KEY.format(c="u")} as key from (select unnest([2 * page_id, 2 * page_id + 1]) as ord, unnest(case when page_id % 7 = 1 then [v, v || '-new'] else [v, null] end) as u
      from (select page_id, url || case when page_id % 3 = 0 then '-old' else '' end as v from pages)) where u is not null)
), missing as (
  select url from listed where r = 1 and key not in (select key from captured)
), extra as (
  select url, status_code, depth, case when status_code >= 400 then 'error' else 'genuine' end as gap from captured where r = 1 and key not in (select key from listed)
)
"""

#: The made site: what its audits must find, as functions of the part's key.
_SITE = """
with part_pages as (
  select p_partkey as k, p_partkey as ord, 'https://site.example/p/' || p_partkey as url, case when p_partkey % 40 = 39 then 404 else 200 end as status_code,
    (p_partkey % 5)::int as depth, p_partkey % 50 = 0 as is_duplicate, trim(repeat(p_name || ' ', (1 + p_partkey % 7)::int)) as title,
    case p_partkey % 4 when 0 then '' when 1 then 'Short ' || p_partkey when 2 then trim(repeat('about ', 12)) else trim(repeat('more about ', 16)) end as description,
    case when p_partkey % 5 = 1 then '' else 'One' end as h1, case when p_partkey % 300 >= 6 then p_partkey % 300 else 0 end::int as article_word_count,
    p_partkey % 11 in (0, 1) as noindex, p_partkey % 11 in (0, 1) as nofollow,
    case p_partkey % 6 when 0 then 'missing' when 2 then 'cross_page' when 3 then 'cross_domain' else 'self' end as canonical_class,
    case p_partkey % 6 when 0 then null when 2 then 'https://site.example/p/' || (p_partkey + 1) when 3 then 'https://other.example/p/' || p_partkey else 'https://site.example/p/' || p_partkey end as canonical,
    [i for i in range(0, p_partkey % 4)] as nth,
    case p_partkey % 3 when 0 then []::varchar[] when 1 then ['Product'] else ['Product', 'Thing', 'Offer'] end as types from part
), site as (
  select *, len(nth)::int as total, len([i for i in nth if (k + i) % 3 = 0])::int as missing, len([i for i in nth if (k + i) % 3 = 1])::int as decorative,
    len([i for i in nth if (k + i) % 3 = 2])::int as present, len([i for i in nth if i = 1])::int as lazy_loaded, len([i for i in nth if (k + i) % 2 = 1])::int as missing_dims from part_pages
), shown as (
  select * from site where not is_duplicate
), links as (
  select k, ord, url, t, n, row_number() over (partition by k order by n) - 1 as pos from (
    select k, ord, url, t, min(n) as n from (select k, ord, url, unnest([2 * k, 2 * k + 1, k // 2]) as t, unnest([0, 1, 2]) as n from shown) group by all)
), edges as (
  select * from links where t in (select k from shown)
), checks as (
  select unnest(['noindex', 'nofollow', 'missing_canonical', 'cross_page_canonical', 'cross_domain_canonical', 'missing_open_graph', 'missing_og_title', 'missing_og_description', 'missing_og_image',
      'missing_twitter_card', 'missing_viewport', 'with_hreflang']) as check,
    unnest([noindex, nofollow, canonical_class = 'missing', canonical_class = 'cross_page', canonical_class = 'cross_domain', k % 3 = 0, false, k % 3 = 2, k % 3 = 2, k % 4 <> 1, k % 2 = 1, k % 10 in (3, 4)]) as found, * from shown
)
"""
_ENTRIES = """
with entries as (
  select p_partkey as ord, 'https://site.example/p/' || p_partkey as url,
    case p_partkey % 5 when 0 then '' when 1 then null when 2 then 'soon' else '2024-0' || (p_partkey % 9 + 1) || '-15' end as lastmod,
    case p_partkey % 4 when 0 then 'daily' when 1 then 'weekly' when 2 then '' end as changefreq, case when p_partkey % 3 > 0 then (p_partkey % 31) / 30 end as priority from part
)
"""
_IMAGES = "sum(total)::bigint as total, sum(missing)::bigint as missing, sum(decorative)::bigint as decorative, sum(present)::bigint as present, sum(lazy_loaded)::bigint as lazy_loaded, sum(missing_dims)::bigint as missing_dims"
_FOUND = ", ".join(f"count(*) filter (\"check\" = '{c}' and found) as {c}" for c in (
    "noindex", "nofollow", "missing_canonical", "cross_page_canonical", "cross_domain_canonical", "missing_open_graph", "missing_og_title", "missing_og_description", "missing_og_image",
    "missing_twitter_card", "missing_viewport", "with_hreflang"))

SQL = {
    "page_flags": _PAGES + "select ord, url, status_code, depth, title, h1, description, word_count, article_word_count, flags from flagged",
    "search_pages": _PAGES + """select url, status_code, depth, title, h1, description, word_count, article_word_count, flags from flagged
        where contains(lower(title || ' ' || h1 || ' '), 'an') and word_count >= 40 and status_code = 200 and contains(url, 'example') order by ord limit 50 offset 5""",
    "sql_search": _PAGES + """select url, status_code, depth, title, h1, description, word_count, article_word_count, flags from flagged
        where contains(lower(title || ' ' || h1 || ' '), 'an') and word_count >= 40 and status_code = 200 and contains(url, 'example') order by ord limit 50 offset 5""",
    "search_matches": _PAGES + "select count(*) as total_matched from flagged where contains(flags, 'WARN_THIN_CONTENT')",
    "status_distribution": _PAGES + "select status_code, count(*) as pages from snap group by status_code",
    "depth_distribution": _PAGES + "select depth, count(*) as pages from snap group by depth",
    "flag_totals": _PAGES + f"select flag, (select count(*) from flagged where list_contains(string_split(flags, ','), flag)) as pages from (select unnest({_FLAGS}) as flag)",
    "word_statistics": _PAGES + """select min(word_count)::bigint as min, max(word_count)::bigint as max, list_sort(list(word_count))[1 + count(*) // 2]::bigint as median, floor(avg(word_count) + 0.5)::bigint as avg from texts""",
    "word_buckets": _PAGES + """, b as (select case when article_word_count < 150 then '<150' when article_word_count < 500 then '150-500' when article_word_count < 1000 then '500-1k'
        when article_word_count < 2000 then '1k-2k' when article_word_count < 5000 then '2k-5k' else '5k+' end as bucket from texts)
        select bucket, (select count(*) from b where b.bucket = k.bucket) as pages from (select unnest(['<150', '150-500', '500-1k', '1k-2k', '2k-5k', '5k+']) as bucket) k""",
    "top_linked": _PAGES + "select href, count(*) as links from links group by href order by links desc, min(ord * 100000 + pos) limit 15",
    "external_hosts": _SITE + """, h as (select ord, 0 as pos, 'h' || (k % 7) || '.example.org' as host from site union all select ord, 1, 'www.h' || (k % 3) || '.example.net' from site where k % 2 = 0)
        select host, count(*) as links from h group by host order by links desc, min(ord * 10 + pos) limit 10""",
    "page_links": _PAGES + "select ord, url, pos, href, anchor from links",
    "url_depths": r"select len(list_filter(string_split(regexp_replace(regexp_replace(url, '^https?://[^/?#]+', ''), '[?#].*$', ''), '/'), lambda x: x <> ''))::int as url_depth, count(*) as urls from pages group by 1",
    "url_keys": rf"""with a as (select page_id, url, {_KEY.format(c="url")} as graph_key, regexp_extract(url, '^https?://([^/?#]+)', 1) as host from pages),
        b as (select *, list_sort(list_filter(string_split(regexp_extract(graph_key, '\?(.*)$', 1), '&'), lambda p: p <> '' and not starts_with(p, 'utm_'))) as q from a)
        select page_id, graph_key, regexp_replace(graph_key, '\?.*$', '') || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end as link_url, regexp_replace(url, '#.*$', '') as seen_key, host from b""",
    "vault_paths": r"""with a as (select page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/?#]+', ''), '[?#].*$', ''), '(.)/$', '\1') as p from pages)
        select page_id, case when p in ('', '/') then 'index.md' else substr(p, 2) || '.md' end as vault_path from a""",
    "url_scopes": """select o_orderkey, o_orderkey % 6 in (0, 3) and not contains(o_orderkey::varchar, '7') as in_scope, o_orderkey % 6 in (0, 1, 3) as in_domain, o_orderkey % 6 = 4 as search_engine,
        o_orderkey % 6 = 4 as scripted, o_orderkey % 6 in (0, 1, 2, 4) as fetchable from orders""",
    "followed_links": """select o_orderkey, 'https://site.example/p/x/' || o_orderkey || '?a=' || o_orderkey || '&b=2' as followed, 'https://site.example/p/x/' || o_orderkey || '?b=2&a=1' as key from orders""",
    "page_graph": _PAGES + """, nodes as (select *, row_number() over (partition by key order by ord desc) as r, min(ord) over (partition by key) as first_ord from keyed where not is_duplicate),
        edges as (select k.key as source, l.href as target from links l join keyed k using (ord) where not k.is_duplicate and l.href in (select key from nodes))
        select key, first_ord as ord, url, depth, (select count(*) from edges where target = key) as in_links, (select count(*) from edges where source = key) as out_links from nodes where r = 1""",
    "broken_links": _PAGES + 'select l.url as "from", href, anchor from links l join keyed k using (ord) where not k.is_duplicate and href not in (select key from keyed where not is_duplicate)',
    "part_degrees": _GRAPH + "select * from nodes",
    "part_orphans": _GRAPH + "select key, 'orphan' as kind from nodes where in_links = 0 and key <> 1 union all select key, 'sink' from nodes where out_links = 0 union all select key, 'single_path' from nodes where in_links = 1",
    "part_totals": _GRAPH + "select (select count(*) from nodes) as page_count, (select count(*) from edges) as total_internal_links",
    "part_hubs": _GRAPH + "select key, in_links from nodes order by in_links desc, key limit 25",
    "part_levels": _GRAPH.replace("with links", "with recursive links") + """, steps as (select distinct source, target from edges), walk using key (node) as (
        select 1::bigint as node, 0 as depth union select e.target, min(w.depth) + 1 from walk w join steps e on e.source = w.node left join recurring.walk r on r.node = e.target where r.node is null group by e.target)
        select node, depth::int as depth from walk""",
    "sitemap_missing": _GAPS + "select url from missing",
    "sitemap_extra": _GAPS + "select url, status_code, depth, gap from extra",
    "sitemap_gap_counts": _GAPS + "select count(*) as captured_not_in_sitemap, 0::bigint as noindex, count(*) filter (gap = 'error') as error, count(*) filter (gap = 'genuine') as genuine, (select count(*) from missing) as in_sitemap_not_captured from extra",
    "undiscovered": _PAGES + f"""select ord, u as url from (select ord, url || case when ord % 2 = 1 then '-found' else '' end as u from keyed) where {_KEY.format(c="u")} not in (select key from keyed)""",
    "duplicate_documents": "select doc_id, coalesce(text, '') <> '' and row_number() over (partition by text order by doc_id) > 1 as is_duplicate from documents",
    "heading_summary": _SITE + """select count(*) as pages_analyzed, count(*) filter (k % 5 = 1) as missing_h1, count(*) filter (k % 5 = 2) as multiple_h1, count(*) filter (k % 5 = 3) as h1_not_first,
        count(*) filter (k % 5 = 4) as skipped_levels from shown""",
    "heading_distribution": _SITE + "select (case k % 5 when 1 then 0 when 2 then 2 else 1 end)::int as h1_count, count(*) as pages from shown group by 1",
    "heading_pages": _SITE + """select case k % 5 when 1 then 'missing_h1' when 2 then 'multiple_h1' when 3 then 'h1_not_first' else 'skipped_levels' end as "check", url, title, depth,
        (case k % 5 when 1 then 0 when 2 then 2 else 1 end)::int as h1_count, case k % 5 when 1 then '' when 2 then 'One|Uno' else 'One' end as h1_texts, case when k % 5 = 4 then 'H1 → H3' end as first_skip from shown where k % 5 > 0""",
    "meta_summary": _SITE + f"select (select count(*) from shown) as pages_analyzed, {_FOUND}, 'de,en,fr' as hreflang_languages from checks",
    "meta_pages": _SITE + 'select "check", ord, url, title, canonical from checks where found',
    "image_summary": _SITE + f"""select count(*) as pages_with_images, {_IMAGES}, count(*) filter (missing > 0) as pages_with_missing_alt, count(*) filter (missing = total) as pages_with_complete_failure,
        count(*) filter (missing_dims > 0) as pages_with_cls_risk, floor(100.0 * sum(present) / (sum(total) - sum(decorative)) + 0.5)::bigint as alt_coverage_rate,
        floor(100.0 * sum(lazy_loaded) / sum(total) + 0.5)::bigint as lazy_load_rate from shown where total > 0""",
    "worst_images": _SITE + """select * from (select 'missing' as by, ord, total, missing, decorative, present, lazy_loaded, missing_dims from shown where missing > 0 order by missing desc, total desc, ord limit 25)
        union all select * from (select 'missing_dims' as by, ord, total, missing, decorative, present, lazy_loaded, missing_dims from shown where missing_dims > 0 order by missing_dims desc, ord limit 25)""",
    "schema_summary": _SITE + """select count(*) as pages_analyzed, count(*) filter (k % 3 > 0) as pages_with_schema, count(*) filter (k % 3 = 0) as pages_without_schema,
        floor(100.0 * count(*) filter (k % 3 > 0) / count(*) + 0.5)::bigint as adoption_rate, 3::bigint as unique_types from shown""",
    "schema_types": _SITE + "select unnest(types) as type, count(*) as pages from shown group by 1",
    "schema_skus": _SITE + "select url, 'Product,Thing' as types, k as value from site where k % 3 = 2",
    "site_flags": _SITE + """select ord, title, description, h1, article_word_count, array_to_string(list_filter([case when status_code >= 400 then 'ERR_4XX' end, case when is_duplicate then 'WARN_DUPLICATE' end,
        case when h1 = '' then 'ERR_MISSING_H1' end, case when description = '' then 'ERR_MISSING_DESC' end, case when article_word_count < 150 then 'WARN_THIN_CONTENT' end,
        case when length(title) > 60 then 'WARN_TITLE_TOO_LONG' when length(title) < 30 then 'WARN_TITLE_TOO_SHORT' end,
        case when length(description) > 160 then 'WARN_DESC_TOO_LONG' when length(description) between 1 and 49 then 'WARN_DESC_TOO_SHORT' end], lambda f: f is not null), ',') as flags from site""",
    "flagged_descriptions": _SITE + "select url, description from site where length(description) > 160 and article_word_count between 20 and 250 order by ord limit 30",
    "single_paths": _SITE + """, one as (select t from edges group by t having count(*) = 1)
        select s.url as key, s.url, s.title, s.depth, e.url as linked_from, 'to ' || e.t as anchor from one join shown s on s.k = one.t join edges e on e.t = one.t""",
    "loose_pages": _SITE + """select url, 'orphan' as kind from shown where k <> 1 and k not in (select t from edges) union all select url, 'sink' from shown where k not in (select k from edges)
        union all select 'https://site.example/p/' || t, 'broken' from links where t not in (select k from shown)""",
    "site_gaps": _SITE + """select url, status_code, noindex, case when noindex then 'noindex' when status_code >= 400 then 'error' else 'genuine' end as gap,
        case when noindex then 'noindex, rightly not listed' when status_code >= 400 then 'HTTP ' || status_code end as note from shown where k % 3 = 0""",
    "sitemap_totals": _ENTRIES + """select count(*) as total_urls, count(*) filter (lastmod <> '') as with_lastmod, count(priority) as with_priority, min(lastmod) filter (lastmod <> '') as oldest_lastmod,
        max(lastmod) filter (lastmod <> '') as newest_lastmod from entries""",
    "sitemap_histograms": _ENTRIES + """select 'priority' as kind, printf('%.1f', priority) as value, count(*) as urls from entries where priority is not null group by all
        union all select 'changefreq', changefreq, count(*) from entries where changefreq <> '' group by all union all select 'url_depth', '2', count(*) from entries""",
    "sitemap_since": _ENTRIES + "select url, lastmod from entries where contains(url, '/p/1') and (coalesce(lastmod, '') = '' or (lastmod <> 'soon' and lastmod >= '2024-05-01'))",
    "index_entries": """select (p_partkey % 20)::int as child, 'https://site.example/p/' || p_partkey as url, 'daily' as changefreq from part where p_partkey % 20 <> 7
        order by p_partkey % 20, p_partkey limit 50000""",
    "robots_allowed": """with u as (select case when p_partkey % 4 = 0 then 'gone' else 'site' end as h, '/p/' || p_partkey || case when p_partkey % 3 = 0 then '?v=' || p_partkey else '' end as p from part)
        select 'https://' || h || '.example' || p as url, case when h = 'gone' then true when starts_with(p, '/p/2?v=') then false when p like '/p/%5' then false when starts_with(p, '/p/11') then true
          else not starts_with(p, '/p/1') end as allowed from u""",
    "saved_pages": _SITE + """select ord, url, status_code, depth, is_duplicate, title, noindex, case when k % 3 = 1 then 'c' end as og_image, total as images,
        (1 + (k % 2 = 0)::int)::int as external, array_to_string(types, ',') as types, case when k % 3 = 2 then k::varchar end as sku from site""",
    "stream_bodies": "select distinct user_id || ' ' || event_type as html from events",
    "failing_extractor": _SITE + "select ord, case when k % 10 <> 7 then k::varchar end as last, case when k % 10 = 7 then 'last' else '' end as errors, 2 as headings from site",
    "saved_results": "select conv_id as api, turn::bigint as turn, role from conversations",
    "articles": _PAGES + r"""select ord as page_id, title, length(c)::int as length, length(c) > 3000 as truncated from (select ord, title, replace(replace(replace(replace(replace(
        trim(regexp_replace(case when article_word_count > 0 then regexp_replace(regexp_replace(art, '</?b>', '', 'g'), '<[^>]+>', ' ', 'g') else body end, '\s+', ' ', 'g')),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') as c from texts)""",
    "client_pages": _PAGES + "select ord as page_id, title, h1, (select count(*) from links l where l.ord = t.ord)::int as internal, 0 as external, len(regexp_extract_all(html, '<h[1-6]>'))::int as headings from texts t",
    "sitemap_files": "select page_id // 50 as file, (row_number() over (partition by page_id // 50 order by page_id) - 1)::int as pos, url, '2024-01-0' || (page_id % 9 + 1) as lastmod, null::varchar as changefreq, ('0.' || (page_id % 10))::double as priority from pages",
    "api_items": """with n as (select conv_id as api, count(*) as n from conversations group by 1)
        select api, (case when n >= 5 then 3 else ceil(n / 2.0) end)::bigint as pages_fetched, (case when n >= 6 then 6 else n end)::bigint as items_collected, n % 2 = 1 and n <= 5 and n < 5 as natural_end from n""",
    "address_classes": """with a as (select o_orderkey, o_orderkey % 256 as a, o_orderkey * 7 % 256 as b, o_orderkey * 13 % 256 as c from orders)
        select o_orderkey, a in (0, 10, 127) or a >= 224 or (a = 100 and b between 64 and 127) or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and (b = 168 or (b = 0 and c = 2)))
          or (a = 198 and b = 51 and c = 100) or (a = 203 and b = 0 and c = 113) as is_private from a""",
    "redirect_ends": """with recursive r as (select p_partkey as s, p_partkey as cur, 0 as hops from part union all select s, cur // 3, hops + 1 from r where cur % 3 = 0 and cur in (select p_partkey from part) and hops < 10)
        select 'https://e.com/' || s as url, 'https://e.com/' || arg_max(cur, hops) as final_url, max(hops)::int as hops from r group by s""",
    "fetch_classes": _PAGES + """select ord, status_code = 200 as is_ok, status_code >= 400 as is_broken, true as is_html, status_code = 503 as is_blocked, octet_length(encode(html)) > 2000 as truncated,
        least(2000, octet_length(encode(html)))::int as kept_bytes from snap""",
    "event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as captures from events group by all",
    "stored_fetches": """with p as (select *, case when page_id % 50 = 49 then 503 when page_id % 20 = 19 then 404 else 200 end as s from pages)
        select case when page_id % 23 not in (5, 6) then url end as url, case when page_id % 23 in (5, 6, 7) then 0 else s end::int as status,
          case when page_id % 23 not in (5, 6, 7) then octet_length(encode(html)) end::int as bytes, case when page_id % 23 not in (5, 6, 7) then page_id::varchar end as part,
          case when page_id % 23 in (5, 6) then 'unreadable record: JSONDecodeError' when page_id % 23 = 7 then 'unreadable body' end as error
        from p where page_id % 23 in (5, 6, 7) or s = 404""",
    "page_files": """select page_id || '.html' as name, case page_id % 5 when 1 then 'utf-16le' when 2 then 'gb2312' when 3 then 'gb18030' when 4 then 'utf-16be' else 'utf-8' end as charset,
        sha256(case when page_id % 5 = 3 then '<meta charset=''GB18030''>' else '' end || html) as html_sha256 from pages""",
    "stream_marks": """select event_id, event_id % 10 <> 0 and row_number() over (partition by user_id, event_type, event_id % 10 = 0 order by event_id) > 1 as is_duplicate from events""",
    "observed_search": _PAGES + """, m as (select * from flagged where contains(lower(title || ' ' || h1 || ' '), 'an') and word_count >= 40 and contains(url, 'example'))
        select url, status_code, depth, title, h1, description, word_count, article_word_count, flags, (select count(*) from m) as total_matched,
          (select count(*) from snap where contains(url, 'example')) as pages_read, 0::bigint as pages_failed from m order by ord limit 50 offset 5""",
    "stream_metrics": _SITE + "select count(*) as rows, count(*) filter (contains(k::varchar, '7')) as failed, 0::bigint as failed_headings, count(*) filter (contains(k::varchar, '7')) as failed_last from site",
    "ranked_pages": """select p_partkey as ord, row_number() over (order by (p_partkey % 3), (case p_partkey % 8 when 4 then 1 when 5 then 1 when 6 then 2 when 7 then 2 else 0 end), p_partkey // 16,
        p_partkey % 8) - 1 as rank from part""",
    "ranked_lists": _SITE + """, loose as (select url, depth from shown where k not in (select k from edges)), one as (select s.url from shown s where k in (select t from edges group by t having count(*) = 1)),
        gone as (select ord, pos, url, t from links where t not in (select k from shown))
        select 'sink' as list, url, row_number() over (order by depth, url) - 1 as rank from loose union all select 'single_path', url, row_number() over (order by url) - 1 from one
        union all select 'broken', url, row_number() over (order by url, ord, pos) - 1 from gone""",
    "json_values": _SITE + """, v as (select ord, 0 as nth, unnest(case when k % 3 = 1 then [('@type', 'STRING', 'Product')] else [('@type.0', 'STRING', 'Product'), ('@type.1', 'STRING', 'Thing'), ('sku', 'BIGINT', k::varchar)] end) as x
          from site where k % 3 > 0 union all select ord, 1, ('@type', 'STRING', 'Offer') from site where k % 3 = 2)
        select ord, nth, x[1] as path, x[2] as type, x[3] as value from v""",
    "nested_items": "select conv_id as api, turn::bigint as turn, role, null::varchar as none, true as natural_end from conversations",
    "address_kinds": """with a as (select p_partkey as k, p_partkey % 6 as f, p_partkey * 3 % 256 as a, p_partkey * 11 % 256 as b, p_partkey * 17 % 256 as c, (p_partkey // 6) % 9 as s from part)
        select k as p_partkey, case when f = 1 then s not in (3, 4) when f in (4, 5) then true else
          a in (0, 10, 127) or a >= 224 or (a = 100 and b between 64 and 127) or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and (b = 168 or (b = 0 and c = 2)))
          or (a = 198 and b = 51 and c = 100) or (a = 203 and b = 0 and c = 113) end as is_private from a""",
    "address_networks": """with n as (select distinct p_partkey % 4 = 0 as v4, case when p_partkey % 4 = 0 then (p_partkey % 223 + 1) * 16777216 + (p_partkey * 7 % 256) * 65536 else p_partkey % 256 end as ip,
          case when p_partkey % 4 = 0 then 8 + p_partkey % 17 else 16 + p_partkey % 20 end as bits,
          case when p_partkey % 4 = 0 then concat_ws('.', p_partkey % 223 + 1, p_partkey * 7 % 256, 0, 0) else '2a' || printf('%02x', p_partkey % 256) || '::' end as name from part where p_partkey % 4 < 2),
        o as (select o_orderkey, o_orderkey % 2 = 0 as v4, (o_orderkey % 223 + 1) * 16777216 + (o_orderkey * 5 % 256) * 65536 + (o_orderkey % 2) * 256 + o_orderkey % 7 as ip, o_orderkey % 256 as low, o_orderkey % 3 as mid from orders)
        select o_orderkey, name || '/' || bits as network from o join n on o.v4 = n.v4
          and case when o.v4 then o.ip >> (32 - bits) = n.ip >> (32 - bits) else o.low = n.ip and o.mid >> greatest(0, 32 - bits) = 0 end""",
    "seeded_locations": """select p_partkey, 'https://site.example/p/' || p_partkey || '?a' || case p_partkey % 12 when 0 then '&' when 1 then '&' when 2 then '/' when 3 then '&lt;' when 4 then '<>"''' when 5 then '&nosuch;'
        when 6 then '&amp' when 7 then '&#xD800;' when 8 then '&#0;' when 9 then '😀' when 10 then '&#1114112;' else '&' end || 'b;é' as url from part""",
    "text_functions": r"""select conv_id, turn, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) as collapsed,
        sha256(replace(trim(text, ' '), ' ', chr(12288) || ' ')) as trimmed, len(regexp_extract_all(text, '\S+')) as words, ' ' || substr(text, 1, 20) || ' a < b' as bare, 'og:x,' || role as others from conversations""",
    "page_notes": """select p_partkey, case p_partkey % 8 when 0 then 'captcha' when 2 then 'captcha' when 3 then 'captcha' when 5 then 'needs scripts' when 6 then 'needs scripts' else '' end as notes,
        p_partkey % 97 = 0 as truncated from part""",
    "link_kinds": """with l as (select p_partkey as ord, 'internal' as side, unnest([0, 1, 2]) as pos,
          unnest(['https://site.example/a?x=1', 'https://site.example/p/sub/c', 'https://site.example/p/' || p_partkey]) as href, unnest(['ugc', null, null]) as rel, unnest([100, 100, 4]) as n from part
        union all select p_partkey, 'external', unnest([0, 1]), unnest(['https://other.example/b', 'data:text/plain,x']), unnest(['sponsored', null]), 100 from part)
        select ord, pos::int as pos, href, rel, n::int as anchor_length, side from l""",
    "saved_entries": _ENTRIES + "select 'sitemap' as source, ord, url, lastmod, changefreq, round(priority, 6) as priority from entries",
    "saved_articles": _PAGES + r"""select 'article' as source, ord as page_id, title, length(c)::int as length, length(c) > 3000 as truncated from (select ord, title, replace(replace(replace(replace(replace(
        trim(regexp_replace(case when article_word_count > 0 then regexp_replace(regexp_replace(art, '</?b>', '', 'g'), '<[^>]+>', ' ', 'g') else body end, '\s+', ' ', 'g')),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') as c from texts)""",
    "json_rows": _ENTRIES + """select '{"url":"' || url || '","lastmod":' || case when lastmod is null then 'null' else '"' || lastmod || '"' end || ',"n":' || ord || '}' as value from entries""",
    "pipe_rows": _SITE + """, f as (select ord, url || ' | 404 | ' || h1 || ' | ' || array_to_string(list_filter(['ERR_4XX', case when is_duplicate then 'WARN_DUPLICATE' end, case when h1 = '' then 'ERR_MISSING_H1' end,
          case when description = '' then 'ERR_MISSING_DESC' end, case when article_word_count < 150 then 'WARN_THIN_CONTENT' end,
          case when length(title) > 60 then 'WARN_TITLE_TOO_LONG' when length(title) < 30 then 'WARN_TITLE_TOO_SHORT' end,
          case when length(description) > 160 then 'WARN_DESC_TOO_LONG' when length(description) between 1 and 49 then 'WARN_DESC_TOO_SHORT' end], lambda x: x is not null), ',') as line
          from site where status_code = 404 order by ord limit 30)
        select 'url | status_code | h1 | flags' || chr(10) || string_agg(line, chr(10) order by ord) as value from f""",
    "fetch_sites": "select o_orderkey, case o_orderkey % 6 when 0 then 'same-origin' when 1 then 'same-site' when 2 then 'same-site' when 3 then 'cross-site' when 4 then 'none' else 'cross-site' end as relation from orders",
    "ranked_audits": _SITE + """, kinds as (select unnest(types) as type, count(*) as pages from shown group by 1)
        select 'type' as list, type as name, row_number() over (order by pages desc, type) - 1 as rank from kinds
        union all select 'heading', url, row_number() over (order by depth, url) - 1 from shown where k % 5 = 4
        union all select 'no_schema', url, row_number() over (order by depth, url) - 1 from shown where k % 3 = 0
        union all select 'genuine', url, row_number() over (order by depth, url) - 1 from shown where k % 3 = 0 and not noindex and status_code < 400
        union all select 'missing', url, row_number() over (order by replace(url, '?', ' ')) - 1 from (select case when k % 3 = 0 then url || '?v=2' else url end as url from site where k % 3 = 0 or is_duplicate)""",
    "sink_list": _SITE + """, sinks as (select url, depth from shown where k not in (select k from edges)), n as (select count(*) as n from sinks)
        select url, depth, n as sinks, case when n > 25 then (n - 25) || ' more' end as note from sinks, n order by depth, url limit 25""",
}
