"""Changes to whole tables: ordered plans, phased migrations, rollback."""
