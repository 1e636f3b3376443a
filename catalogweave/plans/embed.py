"""The embedding job: summaries of the catalogue to a vector store."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.embed import HashedTokenEncoder, embed_texts
from ..operators.merge import replace_embeddings, upsert_embeddings
from ..session import staged
from ..sources.catalogue import read_table
from ..sources.embeddings import as_store, merge_embeddings, write_embeddings


def summaries(core: DataFrame) -> DataFrame:
    """Works that have a summary to embed."""
    return core.where(F.col("summary").isNotNull()).select("fic_id", "summary")


def embed_works(
    core: DataFrame, make_encoder=HashedTokenEncoder, model_name: str = HashedTokenEncoder.model_name
) -> DataFrame:
    """Store rows (fic_id, embedding, model_name, dim) for all works with a summary."""
    return as_store(embed_texts(summaries(core), make_encoder), model_name)


def embed_catalogue(
    spark: SparkSession,
    root: str,
    store_path: str,
    make_encoder=HashedTokenEncoder,
    model_name: str = HashedTokenEncoder.model_name,
    replace: bool = True,
) -> None:
    """Embed the published works into the store at ``store_path``.

    The encoder runs once: its output is staged before it is checked and written.
    """
    fresh = staged(embed_works(read_table(spark, root, "fics"), make_encoder, model_name), "vectors")
    if replace:
        write_embeddings(replace_embeddings(fresh), store_path)
    else:
        merge_embeddings(fresh, store_path, upsert_embeddings)
