"""Common parts of the check SQL: the tables as the graph sees them."""

N = "n as (select * from (select *, row_number() over (partition by id order by updated_at desc) as rn from nodes where id is not null) where rn = 1)"
F = "f as (select * from (select *, row_number() over (partition by path order by indexed_at desc) as rn from files where path is not null) where rn = 1)"
E = """e as (select id, source, target, kind, line, col, metadata from (
  select *, row_number() over (partition by source, target, kind, coalesce(line, -1), coalesce(col, -1) order by id) as rn from edges
  where source in (select id from nodes) and target in (select id from nodes)) where rn = 1)"""
L = "l as (select distinct source, target, kind from edges where source in (select id from nodes) and target in (select id from nodes))"
R = "r as (select * from refs where from_node_id in (select id from nodes))"
DEPS = """deps as (select distinct s.file_path as path, t.file_path as depends_on from l join n s on s.id = l.source join n t on t.id = l.target
  where l.kind <> 'contains' and s.file_path <> t.file_path)"""


def with_(*parts: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)} "
