"""The same results in plain SQL, one statement per query, for cross-checking.

Written the long way on purpose: every level is its own GROUP BY and every set
operation is spelled out, so that it shares no method with the Spark side.
"""

from __future__ import annotations

import re

from promolift.functions import levels as L
from testbed.tables import PRE_WEEKS

WEEK = "cast(cast(year({d})*100 + floor((dayofyear({d})-1)/7) + 1 as int) as varchar)"


def week(d: str) -> str:
    return WEEK.format(d=d)


def card(k: str) -> str:
    return f"concat('0', cast(100000 + {k}*37 as varchar))"


def snapshots(expr: str, name: str) -> str:
    return f"""select {card('c_custkey')} as id, {expr} as {name}, '199926' as seg_week from customer
      union all select {card('c_custkey')}, 'OLD', '199925' from customer"""


CTES = {
    "lines": """select * from lineitem join orders on l_orderkey = o_orderkey
      join customer on c_custkey = o_custkey""",
    "detail": f"""select case when l_linenumber in (5, 6) and l_orderkey % 97 = 0 then null
        when l_linenumber in (5, 6) and l_orderkey % 89 = 0 then ''
        when l_linenumber in (5, 6) and l_orderkey % 83 = 0 then 'null'
        else {card('o_custkey')} end as id,
      case l_linenumber when 1 then 'ALC' when 2 then 'DLV' when 3 then 'EXP' when 4 then 'EXP'
        when 5 then 'RDM' when 6 then 'RDM' else 'ACT' end as contact_stage_code,
      concat('OF', l_partkey % 40) as offer_code, concat('P', l_partkey % 50) as prod_code,
      concat('S', l_suppkey) as store_code,
      case l_returnflag when 'A' then 'DIGITAL_APP' when 'R' then 'PAPER_DM' else 'EMAIL' end
        as channel_code,
      l_quantity as offer_rank_num, l_extendedprice * l_discount + 0.0 as offer_discount_amt,
      o_orderdate as contact_cust_detail_dttm, cast(year(o_orderdate) as varchar) as fis_year_id,
      {week('o_orderdate')} as fis_week_id, concat('EV', l_orderkey % 4) as event_code
      from lines""",
    "header": f"""select {card('c_custkey')} as id, 'ALC' as contact_stage_code,
      case when c_custkey % 5 = 0 then 'Y' else 'N' end as event_control_flag,
      case when c_custkey % 4 = 0 then 'Y' when c_custkey % 4 = 1 then null else 'N' end
        as less_loyal_flag, concat('EV', c_custkey % 4) as event_code from customer""",
    "offer_product": """select distinct concat('OF', p_partkey % 40) as offer_code,
      concat('P', p_partkey % 50) as prod_code from part where (p_partkey % 200) % 7 <> 0""",
    "offer_dim": """select concat('OF', p_partkey % 40) as offer_code, p_brand as supplier_name,
      max(p_retailprice * 0.05) as offer_discount_amt, cast(max(p_size) as double) as offer_amount
      from part group by 1, 2""",
    "seg_lifestyle": snapshots(
        "case when c_custkey % 13 = 0 then null else c_mktsegment end", "lifestyle_level"),
    "seg_loyalty": snapshots(
        """case when c_custkey % 11 = 0 then null when c_acctbal < 500 then 'GO'
        when c_acctbal < 2000 then 'LP' when c_acctbal < 5000 then 'OC'
        when c_acctbal < 7500 then 'VL' else 'PR' end""", "loyalty_level"),
    "seg_pricesense": snapshots(
        "case c_nationkey % 3 when 0 then 'LA' when 1 then 'MM' else 'UM' end", "pricesense_code"),
    "cards": f"""select {card('c_custkey')} as id, cast(c_custkey as varchar) as card_id,
      case when c_custkey % 17 = 0 then null
        else date '1930-01-01' + cast(c_custkey * 53 % 33000 as int) end as card_birth_date,
      case when c_custkey % 10 = 0 then date '2000-01-01' end as card_termination_date,
      case when c_custkey % 6 = 0 then 'Y' else 'N' end as card_address_valid_flag,
      case when c_nationkey % 4 = 0 then 'SE' else 'NO' end as card_address_country_code,
      case when c_custkey % 9 = 0 then 'Y' else '' end as card_analyse_now_suppress_flag,
      case when c_custkey % 8 = 0 then 'Y' else 'N' end as card_suppress_flag from customer""",
    "members": """select cast(100000 + c_custkey * 37 as varchar) as member_id,
      case when c_custkey % 14 = 0 then '19991231' when c_custkey % 3 = 0 then null
        else '00000000' end as deceased_date from customer""",
    "products": """select concat('P', p_partkey % 50) as prod_code,
      concat('C', (p_partkey % 50) % 8) as prod_hier_l20_code, min(p_name) as prod_desc
      from part group by 1, 2""",
    "stores": """select concat('S', s_suppkey) as store_code, n_name as banner_name
      from supplier join nation on s_nationkey = n_nationkey""",
    "calendar": f"""select cast(d as date) as date, {week('d')} as fis_week_id,
      cast((dayofyear(d) - 1) % 7 + 1 as varchar) as fis_day_of_week_num
      from (select unnest(generate_series(
        (select min(o_orderdate)::date::timestamp from orders),
        (select max(o_orderdate)::date::timestamp from orders), interval 1 day)) as d)""",
    "raw_items": f"""select case when l_orderkey % 101 = 0 then ''
        when l_orderkey % 103 = 0 then null else {card('o_custkey')} end as id,
      concat('P', l_partkey % 50) as prod_code, cast(l_partkey as varchar) as prod_id,
      cast(l_orderkey as varchar) as transaction_fid,
      l_extendedprice * (1 - l_discount) as net_spend_amt, l_quantity as quantity,
      cast(o_orderdate as date) as transaction_day, {week('o_orderdate')} as fis_week_id
      from lines""",
    "items": """select id, prod_code, prod_id, transaction_fid, cast(trunc(net_spend_amt) as bigint) as spend,
      transaction_day, fis_week_id from raw_items
      where id is not null and trim(id) <> '' and trim(prod_code) <> ''""",
    "items_pre": "select * from items where fis_week_id between '199801' and '199953'",
    "items_dur": "select * from items where fis_week_id between '200001' and '200053'",
    "items_post": "select * from items where fis_week_id between '200101' and '200153'",
    "raw_baskets": """select transaction_fid, id, transaction_day, fis_week_id,
      round(sum(net_spend_amt), 4) as basket_spend_amt, sum(quantity) as item
      from raw_items group by 1, 2, 3, 4""",
    "baskets": """select id, transaction_fid, cast(trunc(basket_spend_amt) as bigint) as spend,
      cast(trunc(item) as bigint) as basket_item_qty, item, transaction_day, fis_week_id
      from raw_baskets where id is not null and trim(id) <> ''""",
    "baskets_pre": "select * from baskets where fis_week_id between '199801' and '199953'",
    "baskets_dur": "select * from baskets where fis_week_id between '200001' and '200053'",
    "panel": f"""select {card('c_custkey')} as id,
      case when c_custkey % 5 = 0 then '0' else '1' end as event_control_flag from customer""",
    "headed": """select d.*, h.event_control_flag, h.less_loyal_flag
      from (select * exclude (event_code) from detail) d
      left join (select id, event_control_flag, less_loyal_flag from header
        where contact_stage_code = 'ALC') h on d.id = h.id""",
    "slotted": """select *, case
        when offer_rank_num between 1 and 8 and less_loyal_flag <> 'Y' then 'baulcm'
        when offer_rank_num between 1 and 3 and less_loyal_flag = 'Y' then 'lessloyal'
        when offer_rank_num between 9 and 12 then 'baby'
        when offer_rank_num between 13 and 20 then 'npm'
        when offer_rank_num between 21 and 24 then 'extralcm'
        when offer_rank_num between 25 and 28 then 'babyextra'
        when offer_rank_num between 29 and 32 then 'nfm'
        when offer_rank_num between 33 and 40 then 'additional' else 'others' end as slot_segment
      from headed""",
    "segmented": """select d.*, lifestyle_level, loyalty_level, pricesense_code
      from (select * exclude (offer_rank_num, less_loyal_flag) from slotted) d
      left join (select id, lifestyle_level from seg_lifestyle
        where seg_week = '199926' and trim(id) <> '') a on d.id = a.id
      left join (select id, loyalty_level from seg_loyalty
        where seg_week = '199926' and trim(id) <> '') b on d.id = b.id
      left join (select id, pricesense_code from seg_pricesense
        where seg_week = '199926' and trim(id) <> '') c on d.id = c.id""",
    "targ": """select min(date) as targ_date from calendar
      where fis_week_id = '199926' and fis_day_of_week_num = '7'""",
    "aged": """select *, case when years > 66 then '67 eller mer' when years > 55 then '56-66'
        when years > 45 then '46-55' when years > 35 then '36-45' when years > 25 then '26-35'
        when years > 0 then '0-25' else 'Uklassifiserte' end as age
      from (select cards.*, date_diff('day', card_birth_date, targ_date) / 365 as years
        from cards, targ)""",
    "terms": """select offer_code, supplier_name, offer_discount_amt as dim_discount, offer_amount
      from (select *, row_number() over (partition by offer_code order by supplier_name nulls last)
          as nth
        from (select offer_code, supplier_name, max(offer_discount_amt) as offer_discount_amt,
            max(offer_amount) as offer_amount from offer_dim
          where trim(offer_code) <> '' group by 1, 2)) where nth = 1""",
    "base": """select d.* exclude (offer_discount_amt), k.* exclude (id, years),
      supplier_name, offer_amount,
      case when contact_stage_code in ('ALC', 'DLV', 'EXP') then dim_discount
        else d.offer_discount_amt end as offer_discount_amt
      from segmented d left join aged k on d.id = k.id left join terms t on d.offer_code = t.offer_code""",
    "alc": "select * from base where contact_stage_code = 'ALC'",
    "exposed": "select * from base where contact_stage_code = 'EXP'",
    "redeemed": "select * from base where contact_stage_code = 'RDM'",
    "correct": """select * from redeemed r where exists
      (select 1 from exposed e where e.id = r.id and e.offer_code = r.offer_code)""",
    "buyers": """select distinct id from items_dur
      where prod_code in (select prod_code from offer_product)""",
    "targeted": """select * from base
      where (channel_code like '%DIGITAL%' and contact_stage_code = 'ACT')
      or (not channel_code like '%DIGITAL%' and contact_stage_code = 'DLV')""",
    "exp_prod": """select e.* exclude (prod_code), p.prod_code
      from exposed e left join offer_product p on e.offer_code = p.offer_code""",
    "exp_prod_dur": """select e.* from exp_prod e join
      (select distinct id, prod_code from items_dur) d on e.id = d.id and e.prod_code = d.prod_code""",
    "post_n": "select id, prod_code, count(*) as n from items_post group by 1, 2",
    "exp_prod_pre": """select e.* from exp_prod e join
      (select distinct id, prod_code from items_pre) d on e.id = d.id and e.prod_code = d.prod_code""",
    "rdm": """select r.* exclude (event_control_flag), a.event_control_flag from redeemed r
      left join (select distinct id, event_control_flag from alc) a on r.id = a.id""",
    "known_rdm": "select * from rdm where id is not null and trim(id) <> '' and id <> 'null'",
    "unexposed": """select id, offer_code from known_rdm
      except select id, offer_code from exposed""",
    "repeated": "select id, offer_code from known_rdm group by 1, 2 having count(*) > 1",
    "misplaced": """select r.* from rdm r join
      (select prod_code, offer_code from rdm except select prod_code, offer_code from offer_product) m
      on r.prod_code = m.prod_code and r.offer_code = m.offer_code""",
    "digital_rdm": "select * from rdm where lower(channel_code) like '%digital%'",
    "paper_rdm": "select * from rdm where lower(channel_code) like '%paper%'",
    "again_digital": """select r.* from digital_rdm r join
      (select id, offer_code from digital_rdm group by 1, 2 having count(*) > 1) d
      on r.id = d.id and r.offer_code = d.offer_code""",
    "again_paper": """select r.* from paper_rdm r join
      (select id, offer_code from paper_rdm group by 1, 2 having count(*) > 1) d
      on r.id = d.id and r.offer_code = d.offer_code""",
    "in_both": """select r.* from rdm r join
      (select id, offer_code from digital_rdm intersect select id, offer_code from paper_rdm) d
      on r.id = d.id and r.offer_code = d.offer_code""",
    "control_shoppers": """select * from alc where event_control_flag = 'Y'
      and id in (select id from buyers)""",
    "loyal_categories": """select id, prod_hier_l20_code from items_pre join products using (prod_code)
      intersect select id, prod_hier_l20_code from items_post join products using (prod_code)""",
    "missed": """select e.* from (select exp_prod.*, prod_hier_l20_code from exp_prod
        left join products using (prod_code)) e
      join loyal_categories c on e.id = c.id and e.prod_hier_l20_code = c.prod_hier_l20_code
      where not exists (select 1 from items_pre i where i.id = e.id and i.prod_code = e.prod_code)
      and not exists (select 1 from items_post i where i.id = e.id and i.prod_code = e.prod_code)""",
    "universe": """select distinct id from cards
      where substring(id, 2, 4) not in ('0000', '0181', '5020', '5027', '6066', '1166', '2345')
      and card_termination_date is null and card_address_valid_flag = 'N'
      and card_address_country_code = 'NO' and card_analyse_now_suppress_flag = ''
      and card_suppress_flag = 'N'
      and id in (select concat('0', member_id) from members
        where deceased_date = '00000000' or deceased_date is null)""",
}
for unit, amount, table in (
    ("item", "count(prod_code)", "items"), ("basket", "sum(basket_item_qty)", "baskets"),
):
    for name, period in (("pre", "pre"), ("post", "dur")):
        CTES[f"{unit}_{name}"] = f"""select id, cast({amount} as bigint) as {name}_units,
          cast(sum(spend) as bigint) as {name}_spend,
          count(distinct transaction_fid) as {name}_visits from {table}_{period} group by 1"""
    CTES[f"{unit}_panel"] = f"""select p.id, cast(p.event_control_flag as int) as event_control_flag,
      {', '.join(f'coalesce({s}_{m}, 0) as {s}_{m}' for s in ('pre', 'post')
                 for m in ('units', 'spend', 'visits'))}
      from panel p left join {unit}_pre a on p.id = a.id left join {unit}_post b on p.id = b.id"""
CTES["weekly"] = "select id, " + ", ".join(
    f"""cast(coalesce(sum(spend) filter (fis_week_id = '{w}'), 0) as bigint) as "{w}\""""
    for w in PRE_WEEKS
) + " from items_pre group by 1"
CTES["cluster_rows"] = """select p.*, coalesce(a.event_control_flag, 'Y') as event_control_flag
  from weekly p join alc a on p.id = a.id"""
CTES["candidates"] = """select p.id, coalesce(a.event_control_flag, 'Y') as event_control_flag, score
  from (select id, cast(sum(spend) as bigint) as score from items_pre group by 1) p
  join (select distinct id, event_control_flag from alc) a on p.id = a.id"""
CTES["clustered"] = """select p.*, concat(coalesce(loyalty_level, 'XX'), coalesce(lifestyle_level, 'XX')) as cluster
  from candidates p join (select distinct id, loyalty_level, lifestyle_level from alc) a on p.id = a.id"""
CTES["placed"] = """select *, (position * kept) // arm as rank, ((position - 1) * kept) // arm as last
  from (select *, count(*) over (partition by cluster, event_control_flag) as arm,
      least(count(*) filter (event_control_flag <> 'Y') over (partition by cluster),
        count(*) filter (event_control_flag = 'Y') over (partition by cluster)) as kept,
      row_number() over (partition by cluster, event_control_flag order by score, md5(id), id) as position
    from clustered)"""
CTES["resampled"] = """select id, event_control_flag, cluster, score,
  case when event_control_flag = 'Y' then 0 else 1 end as test_panel
  from placed where kept >= 10 and rank > last"""
CTES["resampled_panel"] = CTES["basket_panel"].replace(
    "cast(p.event_control_flag as int)", "p.test_panel").replace("from panel p", "from resampled p")

ORDER = list(CTES)


def statement(body: str) -> str:
    """A query with the tables it needs, in order of definition."""
    words = lambda text: set(re.findall(r"[a-z_0-9]+", text))
    needed, open_names = set(), words(body) & CTES.keys()
    while open_names:
        name = open_names.pop()
        needed.add(name)
        open_names |= (words(CTES[name]) & CTES.keys()) - needed
    ctes = ",\n".join(f"{name} as ({CTES[name]})" for name in ORDER if name in needed)
    return f"with {ctes}\n{body}" if ctes else body


def leveled(source: str, levels, measures: dict[str, str], keys=None) -> str:
    """One GROUP BY per level, stacked."""
    levels = L.parse_levels(levels)
    keys = keys or L.key_columns(levels)
    selects = []
    for level in levels:
        columns = [
            f"coalesce(cast({k} as varchar), 'XX') as {k}" if k in level else f"'total' as {k}"
            for k in keys
        ]
        columns.append(f"'{L.level_name(level)}' as grouping_level")
        columns += [f"{sql} as {name}" for name, sql in measures.items()]
        grouped = ", ".join(f"coalesce(cast({k} as varchar), 'XX')" for k in level)
        selects.append(
            f"select {', '.join(columns)} from {source}" + (f" group by {grouped}" if level else "")
        )
    return "\nunion all ".join(selects)


def one_row(keys: list[str], measure: str, sql: str) -> str:
    columns = [f"'total' as {k}" for k in keys]
    return f"select {', '.join(columns)}, 'overall' as grouping_level, {sql} as {measure}"


def joined(left: str, right: str, keys: list[str], measure: str, sql: str) -> str:
    """Two levelled results side by side where both have the group."""
    using = ", ".join([*keys, "grouping_level"])
    return f"select {using}, {sql} as {measure} from ({left}) join ({right}) using ({using})"


def num(sql: str, digits: int = 4) -> str:
    return f"round(coalesce({sql}, 0) + 1e-{digits + 3}, {digits}) + 0.0"


def ratio(a: str, b: str) -> str:
    return f"(cast({a} as double) / nullif(cast({b} as double), 0))"
