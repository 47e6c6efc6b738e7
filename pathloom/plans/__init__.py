"""Named queries: operators applied to the tables of a data folder, with SQL of the same meaning where there is one."""
