"""DataFrame operators: checks, probes, measures, diffs, judgements, audits."""
