"""Schemas of raw postings, postings and runs."""

RAW = "fuente string, url string, puesto string, empresa string, descripcion_html string, texto_plano string, ubicacion_texto string, sueldo_texto string, publicado date, id_externo string, extra map<string,string>"
POSTING = "huella string, fuente string, url string, puesto string, empresa string, ciudad string, departamento string, modalidad string, categoria string, sueldo_min int, sueldo_max int, moneda string, sueldo_periodo string, resumen string, funciones array<string>, requisitos array<string>, beneficios array<string>, publicado date, vence date, capturado timestamp, visto_ultima_vez timestamp, score int, detalle_score map<string,int>, motivos_rechazo array<string>, aprobada boolean, vigente boolean, perfil string, sueldo_confianza int"
RUN = "id bigint, inicio timestamp, fin timestamp, fuente string, leidas int, aprobadas int, rechazadas int, detalle string"
