"""Plans: whole-corpus pipelines that combine sources and operators."""
