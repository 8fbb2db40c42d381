"""The registered queries in SQL on the tables, without topic, JSON or stream."""

PARSED = """
select cast(o_orderkey as varchar) as InvoiceNumber, epoch_ms(o_orderdate) as CreatedTime,
  'STR' || c_nationkey as StoreID, 'POS' || (o_custkey % 100) as PosID, 'OAS' || (o_orderkey % 50) as CashierID,
  case when c_mktsegment = 'BUILDING' then 'PRIME' else 'NONPRIME' end as CustomerType,
  cast(o_custkey as varchar) as CustomerCardNo, o_totalprice as TotalAmount, cast(coalesce(n, 0) as int) as NumberOfItems,
  case when o_orderpriority < '3' then 'CARD' else 'CASH' end as PaymentMethod,
  o_totalprice * 0.025 as CGST, o_totalprice * 0.025 as SGST, o_totalprice * 0.00125 as CESS,
  case when o_orderstatus = 'O' then 'HOME-DELIVERY' else 'TAKEAWAY' end as DeliveryType,
  case when o_orderstatus = 'O' then c_name end as AddressLine,
  case when o_orderstatus = 'O' then n_name end as City,
  case when o_orderstatus = 'O' then r_name end as State,
  case when o_orderstatus = 'O' then printf('%06d', o_orderkey) end as PinCode,
  case when o_orderstatus = 'O' then cast(o_custkey as varchar) end as ContactNumber
from orders left join (select l_orderkey, count(*) as n from lineitem group by l_orderkey) on o_orderkey = l_orderkey
  left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey
  left join region on n_regionkey = r_regionkey
"""

POINTS = """
select cast(o_orderkey as varchar) as InvoiceNumber, cast(o_custkey as varchar) as CustomerCardNo,
  o_totalprice as TotalAmount, o_totalprice * 0.2 as EarnedLoyaltyPoints
from orders
"""

MESSAGES = """
select cast(o_orderkey as varchar) as key,
  cast(to_json({'CustomerCardNo': cast(o_custkey as varchar), 'TotalAmount': o_totalprice,
    'EarnedLoyaltyPoints': o_totalprice * 0.2}) as varchar) as value
from orders
"""

LINE_ITEMS = """
select cast(o_orderkey as varchar) as InvoiceNumber, epoch_ms(o_orderdate) as CreatedTime,
  'STR' || c_nationkey as StoreID, 'POS' || (o_custkey % 100) as PosID,
  case when c_mktsegment = 'BUILDING' then 'PRIME' else 'NONPRIME' end as CustomerType,
  case when o_orderpriority < '3' then 'CARD' else 'CASH' end as PaymentMethod,
  case when o_orderstatus = 'O' then 'HOME-DELIVERY' else 'TAKEAWAY' end as DeliveryType,
  case when o_orderstatus = 'O' then n_name end as City,
  case when o_orderstatus = 'O' then r_name end as State,
  case when o_orderstatus = 'O' then printf('%06d', o_orderkey) end as PinCode,
  cast(l_partkey as varchar) as ItemCode, p_name as ItemDescription, p_retailprice as ItemPrice,
  cast(l_quantity as int) as ItemQty, l_extendedprice as TotalValue
from orders join lineitem on o_orderkey = l_orderkey left join part on l_partkey = p_partkey
  left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey
  left join region on n_regionkey = r_regionkey
"""

UNREADABLE = """
select doc_id, cast(null as varchar) as key, '{}' as value from documents
union all select doc_id, cast(doc_id as varchar),
  cast(to_json({'CustomerCardNo': source, 'TotalAmount': cast(n_chars as double),
    'EarnedLoyaltyPoints': n_chars * 0.2::double}) as varchar)
from documents
"""

EVENT_PROPS = "select event_id, cast(json_extract(props, '$.k') as int) as k from events"

ORACLES: dict[str, str] = {
    "parse_invoices": PARSED,
    "loyalty_points": POINTS,
    "notification_messages": MESSAGES,
    "flatten_line_items": LINE_ITEMS,
    "unreadable_records": UNREADABLE,
    "event_props": EVENT_PROPS,
    "notification_stream": MESSAGES,
    "flatten_stream": LINE_ITEMS,
    "restarted_stream": LINE_ITEMS,
    "invoice_job": LINE_ITEMS,
    "invoice_job_messages": MESSAGES,
}
