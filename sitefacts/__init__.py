"""Company facts from tables of pages, links, registry lines and status logs, as Spark jobs."""
