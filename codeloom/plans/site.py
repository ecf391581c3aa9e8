"""A whole documentation site from a graph: plan, page contexts, prompts, texts, files."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame

from codeloom.checkpoints import cut
from codeloom.operators.search import write_index
from codeloom.plans import pages, planner, render
from codeloom.plans.context import PageParts
from codeloom.schema import Graph


def generate_site(g: Graph, folder: str | None = None, contents: DataFrame | None = None, plan_llm: Callable[[str, str], str] | None = None, page_llm: Callable[[str], str] | None = None) -> tuple[planner.SitePlan, DataFrame]:
    """(plan, site) with the site's files (path, content), written to ``folder`` if one is named.

    contents: (path, content) of source files. Models are optional: without one the plan is made of directories, and a page is its own prompt.
    """
    plan = planner.site_plan(g, plan_llm)
    sections = cut(plan.sections)
    parts = PageParts(g, sections, contents, write_index(g.nodes))
    written = cut(pages.generate(pages.page_prompts(parts), page_llm))
    site = render.assemble(sections, written, plan.title, plan.description, render.statistics(g), datetime.date.today().isoformat())
    if folder is not None:
        render.write_site(site, folder)
    return planner.SitePlan(plan.title, plan.description, sections), site
