"""All facts of repositories from their files, and the missing controls that follow from them.

files: repo, path, content, masked, bare (extract.with_masks), best as a written table: each reader goes over it once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import code_facts, extract, platforms, rules
from wardline.session import materialize

_SEP = "\x01/"  # between repository and path, where a reader knows paths only


@dataclass
class Facts:
    frameworks: DataFrame
    routes: DataFrame
    auth: DataFrame
    stores: DataFrame
    env: DataFrame
    deployments: DataFrame
    deps: DataFrame
    uses: DataFrame

    @property
    def bodies(self) -> DataFrame:
        return self.routes.select("repo", "route_id", "body")


def _by_repo(files: DataFrame, reader) -> DataFrame:
    """What a reader of (path, content) finds, with repo and file."""
    found = reader(files.select(F.concat("repo", F.lit(_SEP), "path").alias("path"), "content"), "path", "content")
    parts = F.split("path", _SEP, 2)
    return found.withColumns({"repo": F.get(parts, F.lit(0)), "file": F.get(parts, F.lit(1))}).drop("path")


def facts(files: DataFrame) -> Facts:
    """Routes, the only facts that need a reader of nesting, are written once; the rest are plans over files."""
    routes = materialize(code_facts.all_routes(files), "routes")
    frameworks = platforms.frameworks(files)
    return Facts(
        frameworks, routes, code_facts.route_auth(routes), platforms.datastores(files, frameworks), _by_repo(files, extract.env_names), code_facts.deployments(files), _by_repo(files, extract.manifest_dependencies), code_facts.use_calls(files),
    )


def gaps(files: DataFrame, f: Facts) -> DataFrame:
    """rules.all_gaps of the facts."""
    routes = f.routes.drop("body")
    return rules.all_gaps(files, routes, f.auth, f.deps, f.uses, f.frameworks, f.stores, f.bodies)
