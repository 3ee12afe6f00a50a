"""The map of an index: services, projected functions, endpoints and neighbours, as one HTML file."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import graph as G
from loomgraph.operators import vectors as V

#: Most functions, endpoints, matches, and similar functions of each that a map shows.
MAX_FUNCTIONS, MAX_ENDPOINTS, MAX_MATCHES, SIMILAR = 5000, 1500, 8000, 5

_PAGE = """<!doctype html><meta charset="utf-8"><title>Code map</title>
<style>body{margin:0;font:13px sans-serif}canvas{display:block}#info{position:fixed;top:8px;left:8px;background:#fffc;padding:6px}</style>
<canvas id="c"></canvas><div id="info"></div><script type="application/json" id="data">__DATA__</script><script>
const d=JSON.parse(document.getElementById("data").textContent),c=document.getElementById("c"),g=c.getContext("2d");
c.width=innerWidth;c.height=innerHeight;const s=Math.min(c.width,c.height)/2.4,
at=f=>[c.width/2+f.x*s,c.height/2+f.y*s],hue=n=>[...n].reduce((a,x)=>(a*31+x.charCodeAt(0))%360,7);
for(const f of d.functions){const[x,y]=at(f);g.fillStyle=`hsl(${hue(f.service)},60%,50%)`;g.fillRect(x-2,y-2,4,4)}
c.onmousemove=e=>{let b=null,m=200;for(const f of d.functions){const[x,y]=at(f),q=(x-e.x)**2+(y-e.y)**2;if(q<m){m=q;b=f}}
document.getElementById("info").textContent=b?b.qualified_name:`${d.functions.length} functions, ${d.services.length} services`};
</script>"""


def payload(t: dict[str, DataFrame]) -> dict:
    """Everything on the map; each part is cut to its cap by a stated order before it reaches the driver."""
    top = G.top_by_degree(t["functions"].filter(~F.col("is_toplevel")), t["calls"], MAX_FUNCTIONS).withColumn("service", T.service_of(F.col("path")))
    points = V.pca_3d(t["vectors"]).withColumnRenamed("fn_id", "id")
    placed = top.join(points, "id", "left").fillna(0.0, ["x", "y", "z"]).select("id", "qualified_name", "service", "degree", "x", "y", "z")
    size = max(1e-9, placed.agg(F.max(F.greatest(F.abs("x"), F.abs("y"), F.abs("z")))).first()[0] or 1.0)
    functions = [{**r.asDict(), **{a: round(r[a] / size, 6) for a in "xyz"}} for r in placed.orderBy("id").collect()]
    services = G.service_stats(t["files"]).join(top.groupBy("service").agg(F.count("*").alias("functions")), "service", "left").join(G.centroids(placed, "service", ["x", "y", "z"]).drop("n"), "service", "left")
    matched = t["matches"].groupBy(F.col("endpoint_id").alias("id")).agg(F.count("*").alias("calls"))
    endpoints = t["endpoints"].join(matched, "id", "left").fillna(0, ["calls"]).orderBy(F.desc("calls"), "id").limit(MAX_ENDPOINTS)
    ids = top.select(F.col("id").alias("fn_id"))
    near = V.neighbours(t["vectors"].join(ids, "fn_id", "left_semi"), SIMILAR)
    plain = lambda df: [r.asDict() for r in df.collect()]
    return {
        "functions": functions,
        "services": plain(services.orderBy("service")),
        "endpoints": plain(endpoints.select("id", "method", "path_norm", "framework", "handler", "calls")),
        "matches": plain(t["matches"].orderBy("client_id", "endpoint_id").limit(MAX_MATCHES)),
        "similar": plain(near.orderBy("fn_id", "rank")),
    }


def write(t: dict[str, DataFrame], path: str) -> dict:
    data = payload(t)
    text = json.dumps(data, allow_nan=False).replace("</", "<\\/")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(_PAGE.replace("__DATA__", text))
    os.replace(path + ".tmp", path)
    return {"path": path, "functions": len(data["functions"]), "services": len(data["services"]), "endpoints": len(data["endpoints"])}
